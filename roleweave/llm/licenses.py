"""License notices in texts: ordered signature rules behind a keyword prefilter, in SQL functions only.

Texts are reduced to lower-cased words joined by single blanks, and rules are regular expressions
over that.  A rule is tried only on texts that hold its keyword.  Of the detections that rules make,
one that lies inside another of higher priority (or of equal priority, if longer or of an earlier
rule) is suppressed, so the most specific notice wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.functions.arrays import with_computed
from roleweave.llm.storage import stage
from roleweave.llm.words import words

#: Fixed values of the contract: phrase and label; every place counts and none is suppressed.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Families: label, keyword that every text with a match holds, the name as a regular expression, versions.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?(?: license)?", ("1 0", "1 1", "2 0")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("1 0", "3 0", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1 0", "3 0", "3")),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", ("2 1", "3 0", "3")),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", ("2 0", "2")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2 0", "2 1", "3 0", "3")),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", ("1", "2 0", "2", "3 0", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2 0", "2", "3 0", "3")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("1 0", "2 0")),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", ("1 0",)),
    ("cddl", "common development", r"common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common public", r"common public licen[cs]e", ("1 0",)),
    ("eupl", "european union", r"european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("osl", "open software", r"open software licen[cs]e", ("1 0", "2 0", "3 0")),
    ("afl", "academic free", r"academic free licen[cs]e", ("1 2", "2 1", "3 0")),
    ("artistic", "artistic", r"artistic licen[cs]e", ("1 0", "2 0")),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("lppl", "latex", r"latex project public licen[cs]e", ("1 0", "1 3")),
    ("odbl", "open database", r"open database licen[cs]e", ("1 0",)),
    ("psf", "python", r"python software foundation licen[cs]e", ("2",)),
    ("zpl", "zope", r"zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("php", "php", r"php licen[cs]e", ("3 0", "3 01")),
    ("qpl", "q public", r"q public licen[cs]e", ("1 0",)),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", ("1 0", "2 0", "2 1")),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)", ("1", "2")),
    ("bsl", "business source", r"business source licen[cs]e", ("1 1",)),
    ("sspl", "server side", r"server side public licen[cs]e", ("1",)),
    ("mit", "mit", r"mit licen[cs]e", ()),
    ("mit", "expat", r"expat licen[cs]e", ()),
    ("isc", "isc", r"isc licen[cs]e", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ()),
    ("boost", "boost", r"boost software licen[cs]e", ("1 0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", ()),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", ("2",)),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ()),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", ()),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", ()),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?", ()),
    ("bsd", "bsd", r"bsd licen[cs]e", ()),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc0", "creative commons zero", r"creative commons zero", ("1 0",)),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc", r"cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd", r"cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa", r"cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc by", r"cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution noncommercial no ?deriv\w*", ("3 0", "4 0")),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike", ("3 0", "4 0")),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", ("3 0", "4 0")),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv\w*", ("3 0", "4 0")),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", ("3 0", "4 0")),
    ("cc-by", "creative commons", r"creative commons attribution", ("2 0", "3 0", "4 0")),
)
#: Words before a name that make a mention a notice.
NOTICES = (
    r"(?:is |are )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?",
    r"(?:is |are )?released under (?:the )?(?:terms of )?(?:the )?",
    r"distributed under (?:the )?(?:terms of )?(?:the )?",
    r"subject to (?:the )?(?:terms of )?(?:the )?",
)
#: Notices that name no license: label, keyword, regular expression, priority.
OTHERS = (
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 30),
    ("copyright", "copyright", r"copyright(?: c)?(?: by)?", 10),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 20),
    ("public-domain", "public domain", r"(?:released (?:in)?to|placed in|dedicated to|in) the public domain", 50),
    ("public-domain", "public domain", r"public domain", 15),
    ("proprietary", "proprietary", r"proprietary and confidential", 40),
    ("proprietary", "without permission", r"(?:not|no part) (?:to )?(?:be |may be )?(?:reproduced|copied|redistributed) without permission", 40),
    ("permissive", "hereby granted", r"permission is hereby granted free of charge", 45),
    ("permissive", "redistribution", r"redistribution and use in source and binary forms", 45),
    ("free-software", "free software", r"this program is free software", 35),
    ("no-warranty", "warranty", r"without (?:any )?warranty(?: of any kind)?", 20),
    ("no-warranty", "as is", r"provided as is", 20),
    ("spdx", "spdx", r"spdx license identifier", 25),
    ("licensed", "licensed under", r"licen[cs]ed under", 5),
    ("licensed", "license", r"see (?:the )?license(?: file)? for details", 12),
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` over blank-joined words, tried where ``keyword`` occurs; high priority wins."""

    label: str
    keyword: str
    pattern: str
    priority: int
    base: bool = False


def rules() -> list[Rule]:
    """Base phrases, then every family by version and notice, in order."""
    out = [Rule(label, phrase, phrase, 100, True) for phrase, label in BASE]
    for label, keyword, name, versions in FAMILIES:
        for version in versions:
            numbered = rf"{name}(?: licen[cs]e)? (?:version |v ?)?{version}"
            tag = f"{label}-{version.replace(' ', '.')}"
            exact = 5 * len(version.split())
            out.append(Rule(tag, keyword, rf"(?:{'|'.join(NOTICES)}){numbered}", 85 + exact))
            out.append(Rule(tag, keyword, rf"{numbered} or (?:any )?later(?: version)?", 87 + exact))
            out.append(Rule(tag, keyword, numbered, 60 + exact))
        for notice in NOTICES:
            out.append(Rule(label, keyword, rf"{notice}{name}(?: licen[cs]e)?", 80))
        out.append(Rule(label, keyword, name, 50))
    out += [Rule(*x) for x in OTHERS]
    return out


#: Detections are compared inside runs of this many words; no rule matches longer runs of words.
REACH = 64


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """All detections: doc_id, text_id, rule, label, priority, base, start, stop (words from 0)."""
    table = rules() if table is None else table
    keywords = sorted({r.keyword for r in table})
    texts = with_computed(
        docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text"),
        {"norm": F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))},
    )
    found = F.array(*[F.when(F.contains("norm", F.lit(k)), F.lit(i)) for i, k in enumerate(keywords)])
    gated = with_computed(texts.drop("text"), {"held": F.array_compact(found)}).filter(F.size("held") > 0)

    place = {k: i for i, k in enumerate(keywords)}
    session = docs.sparkSession
    listed = session.createDataFrame(
        [(n, place[r.keyword], r.label, r.pattern, r.priority, r.base) for n, r in enumerate(table)],
        "rule int, held int, label string, pattern string, priority int, base boolean",
    )
    tried = gated.withColumn("held", F.explode("held")).join(F.broadcast(listed), "held")
    bounded = F.concat(F.lit("(?<= )(?:"), F.col("pattern"), F.lit(")(?= )"))
    matched = with_computed(tried, {"matched": F.regexp_extract_all("norm", bounded, F.lit(0))}).filter(F.size("matched") > 0)
    marked = F.split(F.regexp_replace("norm", bounded, F.lit("\u0001$0")), " ")
    starts = F.filter(
        F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\u0001")), i - 1)), lambda i: i.isNotNull()
    )
    lengths = F.transform("matched", lambda m: F.size(F.split(m, " ")))
    return matched.select(
        "doc_id", "text_id", "rule", "label", "priority", "base",
        F.explode(F.arrays_zip(starts.alias("start"), lengths.alias("n"))).alias("at"),
    ).select(
        "doc_id", "text_id", "rule", "label", "priority", "base", F.col("at.start").alias("start"),
        (F.col("at.start") + F.col("at.n")).alias("stop"),
    )


def resolve(detections: DataFrame) -> DataFrame:
    """Detections that no stronger one contains; base ones all stay.

    Both sides meet in runs of ``REACH`` words, so the work follows the detections near each other
    and not the length of the text.
    """
    run = lambda c: F.floor(F.col(c) / REACH)
    outer = detections.select(
        F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), F.col("rule").alias("_rule"),
        F.col("priority").alias("_priority"), F.col("start").alias("_start"), F.col("stop").alias("_stop"),
        F.explode(F.sequence(run("start"), run("stop"))).alias("_run"),
    ).distinct()
    longer = F.col("_stop") - F.col("_start") - (F.col("stop") - F.col("start"))
    stronger = (
        (F.col("_priority") > F.col("priority"))
        | ((F.col("_priority") == F.col("priority")) & (longer > 0))
        | ((F.col("_priority") == F.col("priority")) & (longer == 0) & (F.col("_rule") < F.col("rule")))
    )
    inside = (F.col("_start") <= F.col("start")) & (F.col("_stop") >= F.col("stop"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_id") == F.col("_t")) & (run("start") == F.col("_run"))
    kept = detections.filter("not base").join(outer, same & inside & stronger, "left_anti")
    return detections.filter("base").unionByName(kept)


def license_notices(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are the outermost of their
    starts (null without any), ``labels`` adds those of the unsuppressed detections; both lists are
    sorted, without repeats and empty if nothing is found.  ``score`` is the highest priority found
    over 100, else 0.  Null and empty texts have no words.  Rows with equal doc_id and text have
    equal results; a null doc_id is a document like others.  Other columns are ignored.
    """
    detections = stage(scan(docs, table).distinct(), "detections")
    kept = resolve(detections)
    base = F.when(F.col("base"), F.col("start"))
    found = kept.groupBy("doc_id", "text_id").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        (F.max("priority") / 100.0).alias("score"),
    ).withColumnsRenamed({"doc_id": "_d", "text_id": "_t"})
    rows = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    joined = rows.join(found, rows.doc_id.eqNullSafe(F.col("_d")) & (rows.text_id == F.col("_t")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(table: list[Rule] | None = None) -> str:
    """DuckDB statement: rules tried at every place of every text, then the containment test.

    RE2 has no look-around, so matches eat their blanks; every blank is doubled first.
    """
    table = rules() if table is None else table
    double = [r.pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") for r in table]
    values = ",\n".join(
        f"({n}, '{r.label}', ' {p} ', '{r.keyword.replace(' ', '  ')}', {r.priority}, {str(r.base).lower()})"
        for n, (r, p) in enumerate(zip(table, double))
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT rid, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
r(rule, label, pattern, keyword, priority, base) AS (VALUES {values}),
m AS (
  SELECT rid, rule, label, priority, base, regexp_extract_all(t, pattern) AS found, regexp_split_to_array(t, pattern) AS pieces
  FROM n, r WHERE contains(t, keyword) AND regexp_matches(t, pattern)),
k AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (
  SELECT rid, rule, label, priority, base,
         CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x) - length(replace(x, ' ', '')))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x) - length(replace(x, ' ', '')))), 0) AS BIGINT) // 2 AS start,
         (length(found[i]) - length(replace(found[i], ' ', ''))) // 2 AS size
  FROM k),
x AS (SELECT row_number() OVER () AS id, * FROM s),
f AS (
  SELECT * FROM x WHERE base OR NOT EXISTS (
    SELECT 1 FROM x AS o WHERE o.rid = x.rid AND o.start <= x.start AND o.start + o.size >= x.start + x.size
      AND (o.priority > x.priority OR (o.priority = x.priority AND (o.size > x.size OR (o.size = x.size AND o.rule < x.rule)))))),
g AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(priority) / 100.0 AS score FROM f GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (rid)
"""
