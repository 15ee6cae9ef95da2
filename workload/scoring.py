"""Scores: overlaps on orders, similarity on documents and benchmark, role fit on postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators import score as R
from roleweave.operators import tfidf as V
from roleweave.operators.classify import spaced_match
from roleweave.operators.joins import dealt_by
from roleweave.operators.pages import page_texts
from roleweave.operators.skills import canonicalize
from workload.common import (
    P_CTE, ROLE_KEYWORDS, STOPWORDS, VOCAB_CTE, postings, query, sql_match, sql_norm, table, vocabulary,
)
from workload.skills import _KNOWN, _extractor, sql_listed, sql_posting_skills, sql_valid

# --- overlap: an order's part words against its customer's returned part words ---------------

_LISTS = """order_words AS (SELECT DISTINCT l_orderkey, o_custkey, unnest(string_split(p_name, ' ')) AS w
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
  customer_words AS (SELECT DISTINCT o_custkey, unnest(string_split(p_name, ' ')) AS w
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
  job AS (SELECT l_orderkey, any_value(o_custkey) AS o_custkey, list_sort(list(w)) AS js FROM order_words GROUP BY 1),
  usr AS (SELECT o_custkey, list_sort(list(w)) AS us FROM customer_words GROUP BY 1),
  pairs AS (SELECT l_orderkey, js, coalesce(us, []) AS us FROM job LEFT JOIN usr USING (o_custkey)),
  parts AS (SELECT l_orderkey, len(js) AS n, list_sort(list_filter(js, lambda x: list_contains(us, x))) AS matched,
    list_sort(list_filter(js, lambda x: NOT list_contains(us, x))) AS missing,
    list_sort(list_filter(us, lambda x: NOT list_contains(js, x))) AS extra FROM pairs)"""


def _lines(spark, sf):
    """(order, customer, word of a part, return flag); a line's words become rows after the joins."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    scan = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    named = dealt_by(scan, scan, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return (
        dealt_by(named, scan, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "o_custkey", F.explode(F.split("p_name", " ")).alias("w"), "l_returnflag")
    )


def _pairs(spark, sf):
    """(order, its words, its customer's words); the words are a small closed set."""
    lines = _lines(spark, sf)
    job = lines.groupBy("l_orderkey", "o_custkey").agg(F.collect_set("w").alias("js"))
    usr = lines.where("l_returnflag = 'R'").groupBy("o_custkey").agg(F.collect_set("w").alias("us"))
    return job.join(usr, "o_custkey", "left").withColumn(
        "us", F.coalesce("us", F.array().cast("array<string>"))
    )


@query(
    "r1_skill_overlap",
    f"""WITH {_LISTS} SELECT l_orderkey, round(CASE WHEN n = 0 THEN 0 WHEN n < 4 AND len(matched) / n > 0.5 THEN 0.5
      ELSE len(matched) / n END, 6) AS score, n < 4 AND len(matched) / n > 0.5 AS capped, n AS job_skills_count,
      array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing, array_to_string(extra, '|') AS extra FROM parts""",
)
def r1(spark, sf):
    o = _pairs(spark, sf).withColumn("o", R.skill_overlap(F.col("us"), F.col("js")))
    return o.select(
        "l_orderkey",
        F.round("o.score", 6).alias("score"),
        F.col("o.capped").alias("capped"),
        F.col("o.job_skills_count").cast("long").alias("job_skills_count"),
        *[T.join_list(F.col(f"o.{c}"), "|").alias(c) for c in ("matched", "missing", "extra")],
    )


@query(
    "r1_overlap_by_rows",
    f"WITH {_LISTS} SELECT l_orderkey, n AS job_skills_count, len(matched) AS matched_count, round(len(matched) / n, 6) AS score FROM parts",
)
def r1_rows(spark, sf):
    lines = _lines(spark, sf)
    job = lines.select("l_orderkey", F.col("w").alias("skill")).distinct()
    usr = lines.where("l_returnflag = 'R'").select("o_custkey", F.col("w").alias("skill"))
    usr = dealt_by(usr, table(spark, sf, "lineitem"), "o_custkey", "skill").distinct()
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey", "left_semi"
    )
    return R.overlap_by_rows(usr, job, pairs, "o_custkey", "l_orderkey").select(
        "l_orderkey", "job_skills_count", "matched_count", F.round("score", 6).alias("score")
    )


_PLAIN = """SELECT l_orderkey, {cols} FROM (SELECT l_orderkey, len(js) AS n, us, js,
  list_sort(list_filter(js, lambda x: list_contains(list_transform(us, lambda y: {clean}), x))) AS matched,
  list_sort(list_filter(js, lambda x: NOT list_contains(list_transform(us, lambda y: {clean}), x))) AS missing FROM
  (SELECT l_orderkey, js, list_transform(us, lambda y: CASE WHEN length(y) > 4 THEN ' ' || upper(y) ELSE upper(y) END) AS us FROM pairs))"""


def _typed(spark, sf):
    raw = F.transform(
        "us", lambda w: F.when(F.length(w) > 4, F.concat(F.lit(" "), F.upper(w))).otherwise(F.upper(w))
    )
    return _pairs(spark, sf).withColumn("us", raw)


@query(
    "r2_plain_overlap",
    f"WITH {_LISTS} " + _PLAIN.format(cols="round(len(matched) / n, 6) AS score, array_to_string(matched, '|') AS matched", clean="lower(trim(y))"),
)
def r2(spark, sf):
    o = _typed(spark, sf).withColumn("o", R.plain_overlap(F.col("us"), F.col("js")))
    return o.select("l_orderkey", F.round("o.score", 6).alias("score"), T.join_list(F.col("o.matched"), "|").alias("matched"))


@query("r3_plain_score", f"WITH {_LISTS} " + _PLAIN.format(cols="round(len(matched) / n, 6) AS score", clean="lower(y)"))
def r3(spark, sf):
    o = R.plain_overlap(F.col("us"), F.col("js"), strip=False)
    return _typed(spark, sf).select("l_orderkey", F.round(o["score"], 6).alias("score"))


@query(
    "r4_matched_missing",
    f"WITH {_LISTS} " + _PLAIN.format(cols="round(len(matched) / n, 6) AS score, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing", clean="lower(trim(y))"),
)
def r4(spark, sf):
    o = _typed(spark, sf).withColumn("o", R.plain_overlap(F.col("us"), F.col("js")))
    return o.select(
        "l_orderkey",
        F.round("o.score", 6).alias("score"),
        *[T.join_list(F.col(f"o.{c}"), "|").alias(c) for c in ("matched", "missing")],
    )


@query("u1_intersection", f"WITH {_LISTS} SELECT l_orderkey, array_to_string(matched, '|') AS common FROM parts")
def u1(spark, sf):
    common = F.sort_array(F.array_intersect("js", "us"))
    return _pairs(spark, sf).select("l_orderkey", T.join_list(common, "|").alias("common"))


@query(
    "u2_difference",
    f"WITH {_LISTS} SELECT l_orderkey, array_to_string(missing, '|') AS missing, array_to_string(extra, '|') AS extra FROM parts",
)
def u2(spark, sf):
    return _pairs(spark, sf).select(
        "l_orderkey",
        T.join_list(F.sort_array(F.array_except("js", "us")), "|").alias("missing"),
        T.join_list(F.sort_array(F.array_except("us", "js")), "|").alias("extra"),
    )


@query(
    "u3_union",
    f"WITH {_LISTS} SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(js, us))), '|') AS either FROM pairs",
)
def u3(spark, sf):
    either = F.sort_array(F.array_union("js", "us"))
    return _pairs(spark, sf).select("l_orderkey", T.join_list(either, "|").alias("either"))


# --- role fit ---------------------------------------------------------------------------------

_ROLE_OF = "CASE lang WHEN 'en' THEN ' Of The' WHEN 'fr' THEN 'les avec' WHEN 'de' THEN 'die und xy nicht' ELSE 'a b' END"


def _role():
    lang = F.col("job_location")
    return (
        F.when(lang == "en", " Of The").when(lang == "fr", "les avec").when(lang == "de", "die und xy nicht")
        .otherwise("a b")
    )


def sql_hits(words) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda k: contains(blob, k))"


@query(
    "r5_role_fit",
    f"""WITH {P_CTE}, b AS (SELECT posting_id, job_location AS lang, {sql_match("job_title || ' ' || job_description")} AS blob, {sql_match('job_title')} AS t FROM postings),
    h AS (SELECT posting_id, t, lang, CASE lang WHEN 'en' THEN {sql_hits(ROLE_KEYWORDS['of the'])} WHEN 'fr' THEN {sql_hits(ROLE_KEYWORDS['les avec'])}
      WHEN 'de' THEN {sql_hits(['die', 'und', 'nicht'])} ELSE [] END AS hits FROM b)
    SELECT posting_id, array_to_string(hits, '|') AS hits, round(least(1.0, CASE lang
      WHEN 'en' THEN len(hits) / {len(ROLE_KEYWORDS['of the'])} + CASE WHEN contains(t, 'of the') THEN 0.3 ELSE 0 END
      WHEN 'fr' THEN len(hits) / {len(ROLE_KEYWORDS['les avec'])} + CASE WHEN contains(t, 'les avec') THEN 0.3 ELSE 0 END
      WHEN 'de' THEN len(hits) / 3 ELSE 0 END), 6) AS score FROM h""",
)
def r5(spark, sf):
    p = postings(spark, sf).withColumn("m", spaced_match(F.col("job_title"), F.col("job_description")))
    fit = R.role_fit(_role(), T.match_text(F.col("job_title")), F.col("m"), vocabulary(spark))
    return p.withColumn("f", fit).select(
        "posting_id", T.join_list(F.col("f.hits"), "|").alias("hits"), F.round("f.score", 6).alias("score")
    )


# --- TF-IDF -----------------------------------------------------------------------------------

CAP = None


def sql_terms(source: str, out: str, bigrams: bool = True) -> str:
    """CTE text: ``source(id, body)`` -> ``out_tf(id, term, tf)``."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    pairs = f"""UNION ALL SELECT id, w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY i) FROM {out}_tok""" if bigrams else ""
    return f"""{out}_tok AS MATERIALIZED (SELECT s.id, u.w, u.i FROM {source} s,
      unnest(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) WITH ORDINALITY AS u(w, i) WHERE u.w NOT IN ({stop})),
    {out}_gram AS (SELECT id, w AS term FROM {out}_tok {pairs}),
    {out}_tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM {out}_gram WHERE term IS NOT NULL GROUP BY id, term)"""


def sql_vocabulary(source: str, out: str, cap: int | None) -> str:
    limit = f"ORDER BY sum(tf) DESC, term LIMIT {cap}" if cap else ""
    return f"""vocab AS MATERIALIZED (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM
      (SELECT term, count(*) AS df FROM {out}_tf GROUP BY term {limit}), (SELECT count(*) AS n FROM {source}))"""


def sql_unit(tf: str, out: str) -> str:
    return f"""{out}_w AS (SELECT id, term, tf * idf AS w FROM {tf} JOIN vocab USING (term)),
    {out} AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {out}_w)"""


QUERY_TEXT = "Thre thin ering license data the thhe token with nicht zu dans pour un le est der Erin thhe"
_DOC_SOURCE = "src AS (SELECT doc_id AS id, text AS body FROM documents)"
_ONE_QUERY = f"qsrc AS (SELECT 0 AS id, '{QUERY_TEXT}' AS body)"


def docs(spark, sf, bigrams=True):
    return table(spark, sf, "documents").select(
        "doc_id", V.term_counts(F.col("text"), STOPWORDS, bigrams).alias("terms")
    )


def _query(spark, bigrams=True):
    return spark.sql("SELECT 1").select(
        V.term_counts(F.lit(QUERY_TEXT), STOPWORDS, bigrams).alias("terms")
    )


def _sql_cosine(cap, bigrams):
    return f"""WITH {_DOC_SOURCE}, {_ONE_QUERY}, {sql_terms('src', 'd', bigrams)}, {sql_terms('qsrc', 'q', bigrams)},
      {sql_vocabulary('src', 'd', cap)}, {sql_unit('d_tf', 'dv')}, {sql_unit('q_tf', 'qv')},
      dots AS (SELECT d.id, sum(d.w * q.w) AS s FROM dv d JOIN qv q USING (term) GROUP BY d.id)
      SELECT src.id AS doc_id, round(coalesce(s, 0), 6) AS similarity FROM src LEFT JOIN dots ON dots.id = src.id"""


@query("r6_tfidf_cosine", _sql_cosine(CAP, True))
def r6(spark, sf):
    found = V.cosine_to_query(docs(spark, sf), _query(spark), "doc_id", max_features=CAP)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("r6b_unigrams_no_cap", _sql_cosine(None, False))
def r6b(spark, sf):
    found = V.cosine_to_query(docs(spark, sf, False), _query(spark, False), "doc_id", max_features=None)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "a10_document_frequency",
    f"""WITH {_DOC_SOURCE}, {sql_terms('src', 'd')}, {sql_vocabulary('src', 'd', CAP)}
      SELECT term, df, round(idf, 6) AS idf FROM vocab""",
)
def a10(spark, sf):
    return V.fit_vocabulary(docs(spark, sf), max_features=CAP).withColumn("idf", F.round("idf", 6))


_MANY = "qsrc AS (SELECT item_id AS id, text AS body FROM benchmark)"
SQL_PAIRS = f"""{_DOC_SOURCE}, {_MANY}, {sql_terms('src', 'd')}, {sql_terms('qsrc', 'q')},
  {sql_vocabulary('src', 'd', CAP)}, {sql_unit('d_tf', 'dv')}, {sql_unit('q_tf', 'qv')},
  pairs AS MATERIALIZED (SELECT q.id AS item_id, d.id AS doc_id, round(sum(d.w * q.w), 6) AS similarity
    FROM dv d JOIN qv q USING (term) GROUP BY q.id, d.id)"""


def profile_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", V.term_counts(F.col("text"), STOPWORDS).alias("terms"))


@query("r6c_cosine_many_profiles", f"WITH {SQL_PAIRS} SELECT * FROM pairs")
def r6c(spark, sf):
    pairs = V.cosine_pairs(docs(spark, sf), profile_terms(spark, sf), "doc_id", "item_id", max_features=CAP)
    return pairs.withColumn("similarity", F.round("similarity", 6))


# --- re-scoring from full texts ---------------------------------------------------------------

SQL_PAGE_TEXT = """page_text AS (SELECT job_link, arg_max(html, length(html)) AS text FROM
  (SELECT job_link, html FROM pages JOIN postings ON posting_id = page_id) GROUP BY job_link)"""
SQL_CHOSEN = f"""{SQL_PAGE_TEXT}, chosen AS (SELECT p.*, coalesce(length(t.text) > length(job_description) + 50, false) AS used_full_desc,
  CASE WHEN coalesce(length(t.text) > length(job_description) + 50, false) THEN t.text ELSE job_description END AS scored_text
  FROM postings p LEFT JOIN page_text t ON t.job_link = p.job_link)"""


def page_text(spark, sf):
    """Full text per posting link: the raw page with the posting's number."""
    links = postings(spark, sf).select("posting_id", "job_link")
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    linked = links.join(pages, F.col("posting_id") == F.col("page_id"))
    return page_texts(linked.withColumn("n_chars", F.length("text")))


@query("r7_j5_choose_text", f"WITH {P_CTE}, {SQL_CHOSEN} SELECT posting_id, used_full_desc, length(scored_text) AS n FROM chosen")
def r7(spark, sf):
    chosen = R.choose_text(postings(spark, sf), page_text(spark, sf))
    return chosen.select("posting_id", "used_full_desc", F.length("scored_text").cast("long").alias("n"))


_HOT = "CASE WHEN doc_id % 3 = 0 THEN 'https://one.example' ELSE concat('https://www.', source, '.example.com/', md5(text)) END AS job_link"
P_HOT = P_CTE.replace("concat('https://www.', source, '.example.com/', md5(text)) AS job_link", _HOT)


@query("r7_j5_hot_link", f"WITH {P_HOT}, {SQL_CHOSEN} SELECT posting_id, used_full_desc, length(scored_text) AS n FROM chosen")
def r7_hot(spark, sf):
    """A third of the postings share one link, hence one page text."""
    hot = F.when(F.col("posting_id") % 3 == 0, "https://one.example").otherwise(F.col("job_link"))
    p = postings(spark, sf).withColumn("job_link", hot)
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    linked = p.select("posting_id", "job_link").join(pages, F.col("posting_id") == F.col("page_id"))
    chosen = R.choose_text(p, page_texts(linked.withColumn("n_chars", F.length("text"))))
    return chosen.select("posting_id", "used_full_desc", F.length("scored_text").cast("long").alias("n"))


@query(
    "r7_rescored_skills",
    f"""WITH {VOCAB_CTE}, {_KNOWN}, {P_CTE}, {SQL_CHOSEN}, texts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM
      (SELECT posting_id AS id, job_title || chr(10) || scored_text AS raw FROM chosen)),
      {sql_posting_skills('texts')} {sql_listed('texts', 'gated')}""",
)
def r7_skills(spark, sf):
    chosen = R.choose_text(postings(spark, sf), page_text(spark, sf))
    skills = _extractor(spark).posting_skills(F.col("job_title"), F.col("scored_text"))
    return chosen.select(F.col("posting_id").alias("doc_id"), T.join_list(skills, "|").alias("skills"))


# --- weighted score, reasons, flags, breakdown -------------------------------------------------

_FACTORS = """factors AS (SELECT l_orderkey, l_linenumber, l_discount * 3 AS sim, l_tax * 12 AS skill, l_quantity / 50 AS fit,
  l_linenumber - 1 AS matched, l_linenumber + l_partkey % 9 - 1 AS total, l_returnflag = 'R' AS full_text,
  l_linestatus = 'F' AS capped FROM lineitem)"""


def _factors(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 3).alias("sim"),
        (F.col("l_tax") * 12).alias("skill"),
        (F.col("l_quantity") / 50).alias("fit"),
        (F.col("l_linenumber") - 1).alias("matched"),
        (F.col("l_linenumber") + F.col("l_partkey") % 9 - 1).alias("total"),
        (F.col("l_returnflag") == "R").alias("full_text"),
        (F.col("l_linestatus") == "F").alias("capped"),
    )


@query(
    "r8_final_score",
    f"WITH {_FACTORS} SELECT l_orderkey, l_linenumber, round(least(0.2 * sim + 0.5 * skill + 0.3 * fit, 1.0), 6) AS final_score FROM factors",
)
def r8(spark, sf):
    weights = (F.lit(0.2), F.lit(0.5), F.lit(0.3))
    final = R.final_score(weights, F.col("sim"), F.col("skill"), F.col("fit"))
    return _factors(spark, sf).select("l_orderkey", "l_linenumber", F.round(final, 6).alias("final_score"))


@query(
    "r9_match_reason",
    f"""WITH {_FACTORS} SELECT l_orderkey, l_linenumber, (CASE WHEN total > 0 THEN matched || ' of ' || total || ' skills found in ' ||
      CASE WHEN full_text THEN 'the full page' ELSE 'the snippet' END ELSE 'Too few skills to judge' END) || ' | ' ||
      CASE WHEN fit >= 0.7 THEN 'duties fit the role well' WHEN fit >= 0.4 THEN 'duties fit the role in part' ELSE 'duties hardly fit the role' END || ' | ' ||
      CASE WHEN sim >= 0.22 THEN 'text close to the profile' WHEN sim >= 0.1 THEN 'text somewhat close to the profile' ELSE 'text far from the profile' END AS reason FROM factors""",
)
def r9(spark, sf):
    reason = R.match_reason(*[F.col(c) for c in ("matched", "total", "fit", "sim", "full_text")])
    return _factors(spark, sf).select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(
    "r11_reliability_flags",
    f"WITH {_FACTORS} SELECT l_orderkey, l_linenumber, capped OR total < 4 AS few_skills, NOT full_text AND total < 8 AS snippet_unreliable FROM factors",
)
def r11(spark, sf):
    return _factors(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        R.few_skills(F.col("capped"), F.col("total")).alias("few_skills"),
        R.snippet_unreliable(F.col("full_text"), F.col("total")).alias("snippet_unreliable"),
    )


@query(
    "r10_fallback_skills",
    f"""WITH {VOCAB_CTE}, {_KNOWN}, {P_CTE}, texts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM
      (SELECT posting_id AS id, job_title || chr(10) || job_description AS raw FROM postings)), {sql_posting_skills('texts')},
      named AS (SELECT DISTINCT id, coalesce(a.canonical, part) AS skill FROM (SELECT posting_id AS id,
        unnest(string_split(lower({sql_norm('job_title')}), ' ')) AS part FROM postings WHERE job_location = 'fr') LEFT JOIN alias a ON a.variant = part WHERE part <> ''),
      listed AS (SELECT id, skill FROM named WHERE {sql_valid('skill')} UNION ALL
        SELECT id, skill FROM gated WHERE id NOT IN (SELECT id FROM named))
      {sql_listed('texts', 'listed')}""",
)
def r10(spark, sf):
    given = F.when(F.col("job_location") == "fr", F.split("job_title", " ")).otherwise(F.array().cast("array<string>"))
    found = _extractor(spark).posting_skills(F.col("job_title"), F.col("job_description"))
    skills = canonicalize(F.when(F.size(given) > 0, given).otherwise(found), vocabulary(spark))
    return postings(spark, sf).select(F.col("posting_id").alias("doc_id"), T.join_list(skills, "|").alias("skills"))


@query(
    "r12_role_breakdown",
    f"""WITH {VOCAB_CTE}, {P_CTE}, b AS (SELECT posting_id, job_title, {sql_match("job_title || ' ' || job_description")} AS blob FROM postings)
      SELECT posting_id, keyword, contains(blob, keyword) AS hit, contains(lower(job_title), 'of the') AS title_bonus,
      round(0.2 * (length(blob) % 7) / 7, 6) AS profile_part, round(0.5 * (length(blob) % 5) / 5, 6) AS skill_part,
      round(0.3 * (length(blob) % 3) / 3, 6) AS role_part FROM b, role_kw WHERE role = 'of the'""",
)
def r12(spark, sf):
    p = postings(spark, sf).withColumn("matching", spaced_match(F.col("job_title"), F.col("job_description")))
    for name, k in (("nlp_score", 7), ("skill_score", 5), ("role_score", 3)):
        p = p.withColumn(name, (F.length("matching") % k) / k)
    weights = (F.lit(0.2), F.lit(0.5), F.lit(0.3))
    parts = R.role_breakdown(p, F.lit("of the"), weights, vocabulary(spark))
    return parts.select(
        "posting_id", "keyword", "hit", "title_bonus",
        *[F.round(c, 6).alias(c) for c in ("profile_part", "skill_part", "role_part")],
    )
