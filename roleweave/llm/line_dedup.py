"""Boilerplate lines by the number of distinct sites that hold them.

Every line's sites go into a HyperLogLog sketch per line hash; partial sketches merge on the way.
Estimates far from the threshold decide at once.  Lines near it get an exact distinct count.
Boilerplate lines are removed from every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions.arrays import with_computed
from roleweave.llm.skew import salted_join
from roleweave.llm.storage import stage


@dataclass(frozen=True)
class Settings:
    """A line on ``sites`` or more distinct sites is boilerplate; blank lines never are.

    A sketch has 2**``precision`` registers, hence a relative error of about 1.04 / 2**(precision/2);
    estimates within ``band`` such errors of the threshold are counted exactly.
    """

    sites: int = 8
    precision: int = 9
    band: float = 5.0

    @property
    def margin(self) -> float:
        return self.band * 1.04 / 2 ** (self.precision / 2)


def split_lines(text: Column) -> Column:
    """The lines of a text, parted by line feeds; a null text has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def line_key(line: Column) -> Column:
    """128-bit identity of a line without outer blanks; null for blank lines."""
    bare = F.trim(F.regexp_replace(line, r"[\s\p{Z}]+", " "))
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def spread_lines(docs: DataFrame) -> DataFrame:
    """One narrow row per line that is not blank: text_id, place, line (its key) and site; a null site is one of its own."""
    site = F.when(F.col("source").isNull(), F.lit("\u0000")).otherwise(F.col("source").cast("string"))
    text = F.col("text").cast("string")
    rows = docs.select(site.alias("site"), text_id(text).alias("text_id"), F.posexplode(split_lines(text)).alias("place", "raw"))
    keyed = with_computed(rows, {"line": line_key(F.col("raw"))})
    return keyed.filter("line is not null").select("text_id", "place", "line", "site")


def text_id(text: Column) -> Column:
    """128 bits, equal for equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def boilerplate(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Keys of lines on at least ``sites`` distinct sites: line, n_sites (exact near the threshold), exact.

    ``lines`` holds line and site.  Lines of one site alone are dropped by a minimum and a maximum
    before any sketch is made.
    """
    several = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a < b").select("line")
    several = stage(several, "several")
    shared = salted_join(lines, several, ["line"], F.col("site"), "left_semi")
    sketches = shared.groupBy("line").agg(F.hll_sketch_agg("site", settings.precision).alias("sketch"))
    estimates = stage(sketches.select("line", F.hll_sketch_estimate("sketch").alias("estimate")), "estimates")
    low, high = settings.sites * (1 - settings.margin), settings.sites * (1 + settings.margin)
    sure = estimates.filter(F.col("estimate") > high).select("line", F.col("estimate").alias("n_sites"), F.lit(False).alias("exact"))
    near = estimates.filter(F.col("estimate").between(low, high)).select("line")
    counted = salted_join(lines, near, ["line"], F.col("site"), "left_semi").select("line", "site").distinct()
    counted = counted.groupBy("line").agg(F.count(F.lit(1)).alias("n_sites"))
    counted = counted.filter(F.col("n_sites") >= settings.sites).withColumn("exact", F.lit(True))
    return stage(sure.union(counted), "boilerplate")


def remove_boilerplate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents without their boilerplate lines: all columns, and n_lines, n_removed, clean_text.

    Lines are compared without outer blanks and with inner runs of blanks as one.  Kept lines stay
    as they are and in order, blank ones too.  A null text stays null, an empty one empty.  Rows with
    a null or repeated doc_id are cleaned each on its text.  Columns named like the three new ones
    are replaced.
    """
    source = docs.drop("n_lines", "n_removed", "clean_text")
    spread = stage(spread_lines(source), "lines")
    bad = boilerplate(spread, settings)
    hits = salted_join(spread, bad.select("line"), ["line"], F.struct("text_id", "place", "site"), "left_semi")
    gone = stage(hits.groupBy("text_id").agg(F.collect_set("place").alias("_gone")), "removed")
    text = F.col("text").cast("string")
    lines = split_lines(text)
    joined = salted_join(
        source.withColumn("_text_id", text_id(text)), gone.withColumnRenamed("text_id", "_text_id"), ["_text_id"], F.col("doc_id"), "left",
        same_plan=True,
    )
    kept = F.filter(lines, lambda line, i: F.coalesce(~F.array_contains("_gone", i), F.lit(True)))
    removed = F.coalesce(F.size("_gone"), F.lit(0))
    n_lines = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"[^\s\p{Z}]"))))
    return joined.select(
        *source.columns, n_lines.cast("long").alias("n_lines"), F.greatest(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.when(F.size("_gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).alias("clean_text"),
    )


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, clean_bytes, clean_sha256 (null text: null)."""
    raw = F.col("clean_text").cast("binary")
    return remove_boilerplate(docs.select("doc_id", "source", "text"), settings).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed",
        F.octet_length(raw).cast("long").alias("clean_bytes"), F.sha2(raw, 256).alias("clean_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, chr(1)) AS site, string_split(text, chr(10)) AS l FROM documents),
x AS (
  SELECT rid, site, i, l[i] AS raw, trim(regexp_replace(l[i], '[\s\p{Z}\x0B\x{1C}-\x{1F}\x{85}]+', ' ', 'g')) AS bare
  FROM (SELECT rid, site, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
b AS (SELECT bare FROM x WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 8),
g AS (
  SELECT rid, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (b.bare IS NOT NULL) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (b.bare IS NULL), '') AS clean
  FROM x LEFT JOIN b USING (bare) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN CAST(strlen(clean) AS BIGINT) END AS clean_bytes, CASE WHEN text IS NOT NULL THEN sha256(clean) END AS clean_sha256
FROM d LEFT JOIN g USING (rid)
"""
