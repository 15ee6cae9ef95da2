"""Benchmark passages inside documents: a prefix-filtered set join with positional checks, in SQL functions only.

A window (13 consecutive words of an item, or a whole shorter item) is contained in a document only
if all its shingles are.  Its shingles are ordered by rarity over the corpus; for full containment
the necessary prefix is the rarest one alone.  Documents meet windows on that shingle, positions
and lengths leave one possible place, and the words at that place are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.skew import salted_join
from roleweave.llm.storage import stage
from roleweave.llm.words import words

WINDOW = 13
SHINGLE = 3
#: A side of up to this many narrow rows (below 300 bytes each) is broadcast; beyond it rows are shuffled.
BROADCAST_ROWS = 200_000


def _runs(tokens: Column, size: Column, count: Column) -> Column:
    """The hash of ``size`` words from each of the first ``count`` places."""
    return F.transform(
        F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(tokens, i, size))
    )


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct pairs of item_id and window (array of words). Items without words or id have none."""
    split = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("all"))
    size = F.size("all")
    starts = F.sequence(F.lit(1), F.greatest(size - width + 1, F.lit(1)))
    return (
        split.filter(size > 0)
        .select("item_id", "all", F.explode(starts).alias("at"))
        .select("item_id", F.slice("all", F.col("at"), F.lit(width)).alias("window"))
        .distinct()
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], small: bool, spread: Column, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right), keys, how) if small else salted_join(left, right, keys, spread, how)


def window_places(docs: DataFrame, passages: DataFrame, width: int = WINDOW) -> DataFrame:
    """Where windows occur: doc_id, text_id, window, start (from 0) and stop of every occurrence.

    ``passages`` is the result of ``windows``; text_id tells apart texts that share a doc_id.
    """
    distinct = stage(passages.select("window").distinct().withColumn("length", F.size("window")), "windows")
    grams = (
        distinct.withColumn("size", F.least(F.lit(SHINGLE), "length"))
        .select("window", "length", "size", F.posexplode(_runs(F.col("window"), F.col("size"), F.col("length") - F.col("size") + 1)).alias("offset", "gram"))
    )
    grams = stage(grams, "grams")
    sizes = [r["size"] for r in grams.select("size").distinct().orderBy("size").collect()]  # 1 to 3
    wanted = stage(grams.select("size", "gram").distinct(), "shingles")
    small = wanted.count() <= BROADCAST_ROWS

    split = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), words(F.col("text")).alias("all"))
    split = split.withColumn("n_words", F.size("all"))
    found = None
    for size in sizes:
        enough = split.filter(F.col("n_words") >= size)
        place = F.posexplode(_runs(F.col("all"), F.lit(size), F.col("n_words") - size + 1)).alias("at", "gram")
        first = F.greatest(F.col("at") - (width - size), F.lit(0))
        near = F.slice("all", first + 1, F.col("at") + width - first).alias("near")  # all words of a window that holds the shingle
        kept = ["doc_id", "text_id", "n_words", "at", "gram"]
        rows = enough.select("doc_id", "text_id", "n_words", "all", place)
        if not small:  # what shuffles is a fixed number of words, never the text
            rows = rows.select(*kept, near)
        hit = _join(rows, wanted.filter(F.col("size") == size).select("gram"), ["gram"], small, F.xxhash64("doc_id", "at"), "left_semi")
        hit = hit.select(*kept, F.lit(size).alias("size"), first.alias("first"), near if small else F.col("near"))
        found = hit if found is None else found.union(hit)
    if found is None:
        found = split.filter("false").select("doc_id", "text_id", "n_words", F.lit(0).alias("at"), F.lit(0).cast("long").alias("gram"), F.lit(1).alias("size"), F.lit(0).alias("first"), F.col("all").alias("near"))
    found = stage(found, "shared-shingles")

    counts = found.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("seen"))
    ranked = grams.join(counts, ["size", "gram"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = (
        ranked.groupBy("window", "length", "size")
        .agg(F.min(F.struct("seen", "gram", "offset")).alias("rarest"))
        .filter("rarest.seen > 0")
        .select("window", "length", "size", "rarest.gram", "rarest.offset")
    )
    prefix = stage(prefix, "prefixes")
    start = F.col("at") - F.col("offset")
    possible = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    equal = F.slice("near", start - F.col("first") + 1, F.col("length")) == F.col("window")
    pairs = _join(found, prefix, ["size", "gram"], prefix.count() <= BROADCAST_ROWS, F.xxhash64("doc_id", "at"))
    return pairs.filter(possible).filter(equal).select(
        "doc_id", "text_id", "window", start.alias("start"), (start + F.col("length")).alias("stop")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_id (equal for equal texts).

    A word is hit if it lies inside an occurrence of a window of any item; a document is contaminated
    if at least one word in twenty is hit.  Null, empty and wordless texts have no words and are
    clean; so is everything if there are no items.  Rows with equal doc_id and text have equal
    results, rows with one doc_id and several texts are judged each on its text, a null doc_id too.
    Items with a null id are left out; items that share an id count once.  Other columns are ignored.
    """
    passages = stage(windows(items, width), "passages")
    places = stage(window_places(docs, passages, width), "places")
    by = ["doc_id", "text_id"]
    merged = F.aggregate(
        F.array_sort(F.col("spans")),
        F.struct(F.lit(0).alias("reach"), F.lit(0).alias("total")),
        lambda have, span: F.struct(
            F.greatest(have["reach"], span["stop"]).alias("reach"),
            (have["total"] + F.greatest(F.lit(0), span["stop"] - F.greatest(have["reach"], span["start"]))).alias("total"),
        ),
        lambda have: have["total"],
    )
    hits = places.groupBy(*by).agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(*by, merged.cast("long").alias("n_hit"))
    seen = places.select(*by, "window").distinct()
    owners = passages.withColumn("item_id", F.col("item_id").cast("string"))
    named = _join(seen, owners, ["window"], passages.count() <= BROADCAST_ROWS, F.col("doc_id")).groupBy(*by).agg(F.collect_set("item_id").alias("items"))
    result = hits.join(named, (hits.doc_id.eqNullSafe(named.doc_id)) & (hits.text_id == named.text_id), "left").select(
        hits.doc_id.alias("_doc"), hits.text_id.alias("_text"), "n_hit", "items"
    )
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    joined = rows.join(result, rows.doc_id.eqNullSafe(F.col("_doc")) & (rows.text_id == F.col("_text")), "left")
    names = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), "text_id",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, width).filter("contaminated").select(
        F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")
    ).distinct()
    bad = stage(bad, "contaminated")
    text_id = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_doc"]) & (text_id == bad["_text"])
    return docs.join(bad, same, "left_anti")


#: The same by equality of whole windows at every position.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS rid FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS k, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, s, g.n, item_id FROM grams AS g JOIN win ON g.k = win.k AND g.n = win.n),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)
"""
