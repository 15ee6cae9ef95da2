"""The search plan end to end, its ranks and pages, and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators import market as M
from roleweave.operators import rank as W
from roleweave.operators import tfidf as V
from roleweave.operators.pages import extract_pages, page_texts
from roleweave.operators.skills import SkillExtractor
from roleweave.plans import search as S
from roleweave.plans.many import search_many
from roleweave.sources.sinks import export_columns
from roleweave.staging import staged
from workload.classify import SQL_DIRECT, SQL_INDUSTRY, SQL_LEVEL, SQL_MODE, SQL_TYPE
from workload.common import (
    CUES, P_CTE, ROLE_KEYWORDS, VOCAB_CTE, postings, query, sql_match, sql_norm, table, vocabulary,
)
from workload.dedup import SQL_DEDUP
from workload.profiles import RAW_PROFILES, SQL_PROFILE_SKILLS, _sql_section, profiles
from workload.scoring import (
    CAP, SQL_PAIRS, docs, profile_terms, sql_hits, sql_terms, sql_unit, sql_vocabulary,
)
from workload.skills import _KNOWN, sql_posting_skills
from workload.web import SQL_MAIN

OPTIONS = S.SearchOptions(max_features=CAP)
PROFILE = 0


def results(spark, sf, *columns):
    """The search of one profile, with the columns that are read; scores are rounded so that both engines rank alike."""
    vocab = vocabulary(spark)
    found = S.search(
        postings(spark, sf), profiles(spark, sf), SkillExtractor(spark, vocab, CUES), vocab, OPTIONS, PROFILE, columns or None
    )
    scores = ("final_score", "nlp_score", "skill_score", "role_score")
    return found.withColumns({c: F.round(c, 6) for c in scores if c in found.columns})


_RK = ROLE_KEYWORDS["of the"]
_FILTER = f"{SQL_DIRECT} AND coalesce(regexp_matches(lower(search_country), 'united states|usa|us'), false)"
SQL_SEARCH = f"""WITH {VOCAB_CTE}, {_KNOWN}, {P_CTE}, {SQL_DEDUP},
  {RAW_PROFILES.replace('FROM benchmark', f'FROM benchmark WHERE item_id = {PROFILE}')},
  {SQL_PROFILE_SKILLS},
  me AS (SELECT role, coalesce((SELECT list(skill ORDER BY skill) FROM profile_skill), []) AS us, resume_text,
    CASE WHEN w_profile + w_skill + w_role = 0 THEN 0.2 ELSE w_profile / (w_profile + w_skill + w_role) END AS w1,
    CASE WHEN w_profile + w_skill + w_role = 0 THEN 0.5 ELSE w_skill / (w_profile + w_skill + w_role) END AS w2,
    CASE WHEN w_profile + w_skill + w_role = 0 THEN 0.3 ELSE w_role / (w_profile + w_skill + w_role) END AS w3 FROM raw_profiles),
  kept AS MATERIALIZED (SELECT * FROM unique_postings WHERE {_FILTER}),
  jtexts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM
    (SELECT posting_id AS id, job_title || chr(10) || job_description AS raw FROM kept)),
  {sql_posting_skills('jtexts', 'j')},
  listed AS (SELECT posting_id AS id, coalesce(list(skill ORDER BY skill) FILTER (skill IS NOT NULL), []) AS js
    FROM kept LEFT JOIN jgated ON jgated.id = posting_id GROUP BY 1),
  blobs AS MATERIALIZED (SELECT k.*, js, array_to_string(js, ', ') AS job_skills,
    {sql_match("job_title || ' ' || job_description")} AS blob, {sql_match('job_title')} AS tmatch,
    {sql_match("contract_type || ' ' || contract_time || ' ' || job_title || ' ' || job_description")} AS tblob
    FROM kept k JOIN listed ON listed.id = posting_id),
  src AS (SELECT posting_id AS id, concat(job_title, ' | ', job_description, ' | ', job_skills, ' | ', company, ' | ', job_location) AS body FROM blobs),
  qsrc AS (SELECT 0 AS id, {sql_norm(f"concat(role, ' ', array_to_string(us, ' '), ' ', {_sql_section('summary_text')}, ' ', {_sql_section('experience_text')})")} AS body FROM me),
  {sql_terms('src', 'd')}, {sql_terms('qsrc', 'q')}, {sql_vocabulary('src', 'd', CAP)},
  {sql_unit('d_tf', 'dv')}, {sql_unit('q_tf', 'qv')},
  dots AS (SELECT d.id, sum(d.w * q.w) AS s FROM dv d JOIN qv q USING (term) GROUP BY d.id),
  factors AS (SELECT b.*, coalesce(s, 0) AS sim, us, w1, w2, w3, {sql_hits(_RK)} AS hits,
    list_filter(js, lambda x: list_contains(us, x)) AS matched, list_filter(js, lambda x: NOT list_contains(us, x)) AS missing,
    list_filter(us, lambda x: NOT list_contains(js, x)) AS extra,
    CASE WHEN len(js) = 0 THEN 0 ELSE len(list_filter(js, lambda x: list_contains(us, x))) / len(js) END AS raw_skill
    FROM blobs b LEFT JOIN dots ON dots.id = posting_id, me),
  scored AS (SELECT *, CASE WHEN len(js) < 4 AND raw_skill > 0.5 THEN 0.5 ELSE raw_skill END AS skill,
    len(js) < 4 AND raw_skill > 0.5 AS capped,
    least(1.0, len(hits) / {len(_RK)} + CASE WHEN contains(tmatch, 'of the') THEN 0.3 ELSE 0 END) AS fit FROM factors),
  results AS MATERIALIZED (SELECT posting_id, arrival_seq, job_title, company, job_location, job_skills, job_link, salary_min, salary_max,
    js, matched, missing, extra, hits, capped, {SQL_INDUSTRY} AS industry, {SQL_MODE} AS work_mode, {SQL_LEVEL} AS job_level_norm,
    {SQL_TYPE} AS employment_type_norm,
    round(sim, 6) AS nlp_score, round(skill, 6) AS skill_score, round(fit, 6) AS role_score,
    round(least(1.0, w1 * sim + w2 * skill + w3 * fit), 6) AS final_score FROM scored)"""


@query(
    "plan_search_results",
    f"""{SQL_SEARCH} SELECT posting_id, job_skills, nlp_score, skill_score, role_score, final_score, capped,
      array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing, array_to_string(extra, '|') AS extra,
      array_to_string(hits, '|') AS hits, industry, work_mode, job_level_norm, employment_type_norm FROM results""",
)
def plan_search(spark, sf):
    return results(spark, sf).select(
        "posting_id", "job_skills", "nlp_score", "skill_score", "role_score", "final_score",
        F.col("skill_score_capped").alias("capped"),
        T.join_list(F.col("matched_skills"), "|").alias("matched"),
        T.join_list(F.col("missing_skills"), "|").alias("missing"),
        T.join_list(F.col("extra_user_skills"), "|").alias("extra"),
        T.join_list(F.col("role_hits"), "|").alias("hits"),
        "industry", "work_mode", "job_level_norm", "employment_type_norm",
    )


@query(
    "plan_search_top",
    f"""{SQL_SEARCH} SELECT posting_id, job_title, company, final_score, nlp_score, skill_score, role_score FROM results
      ORDER BY final_score DESC, arrival_seq LIMIT 10""",
)
def plan_top(spark, sf):
    shown = ("posting_id", "job_title", "company", "final_score", "nlp_score", "skill_score", "role_score")
    return W.top_k(results(spark, sf, "arrival_seq", *shown), W.sort_keys("Best Match"), 10).select(*shown)


_SQL_ROLE_WORDS = "list_filter(string_split(lower(trim(role)), ' '), lambda w: length(w) >= 3)"
SQL_SEARCH_MANY = f"""WITH {VOCAB_CTE}, {_KNOWN}, {P_CTE}, {SQL_DEDUP}, {RAW_PROFILES}, {SQL_PROFILE_SKILLS},
  known_roles AS (SELECT role AS rkey, list(keyword ORDER BY pos) AS kws FROM role_kw GROUP BY 1),
  listed_skills AS (SELECT id, list(skill ORDER BY skill) AS us FROM profile_skill GROUP BY 1),
  me AS MATERIALIZED (SELECT profile_id, lower(trim(role)) AS rkey, r.rkey IS NOT NULL AND lower(trim(role)) <> '' AS named,
    coalesce(r.kws, {_SQL_ROLE_WORDS}) AS kws, coalesce(us, []) AS us,
    coalesce(nullif({sql_norm(f"concat(role, ' ', array_to_string(coalesce(us, []), ' '), ' ', {_sql_section('summary_text')}, ' ', {_sql_section('experience_text')})")}, ''), {sql_norm('role')}) AS body,
    CASE WHEN w_profile + w_skill + w_role = 0 THEN 0.2 ELSE w_profile / (w_profile + w_skill + w_role) END AS w1,
    CASE WHEN w_profile + w_skill + w_role = 0 THEN 0.5 ELSE w_skill / (w_profile + w_skill + w_role) END AS w2,
    CASE WHEN w_profile + w_skill + w_role = 0 THEN 0.3 ELSE w_role / (w_profile + w_skill + w_role) END AS w3
    FROM raw_profiles LEFT JOIN known_roles r ON r.rkey = lower(trim(role)) LEFT JOIN listed_skills ON id = profile_id
    WHERE NOT ({sql_norm('role')} = '' AND len(coalesce(us, [])) = 0 AND {sql_norm('resume_text')} = '')),
  kept AS MATERIALIZED (SELECT * FROM unique_postings WHERE {_FILTER}),
  jtexts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM
    (SELECT posting_id AS id, job_title || chr(10) || job_description AS raw FROM kept)),
  {sql_posting_skills('jtexts', 'j')},
  listed AS (SELECT posting_id AS id, coalesce(list(skill ORDER BY skill) FILTER (skill IS NOT NULL), []) AS js
    FROM kept LEFT JOIN jgated ON jgated.id = posting_id GROUP BY 1),
  blobs AS MATERIALIZED (SELECT posting_id, arrival_seq, js, {sql_match("job_title || ' ' || job_description")} AS blob, {sql_match('job_title')} AS tmatch,
    concat(job_title, ' | ', job_description, ' | ', array_to_string(js, ', '), ' | ', company, ' | ', job_location) AS body
    FROM kept JOIN listed ON listed.id = posting_id),
  src AS (SELECT posting_id AS id, body FROM blobs), qsrc AS (SELECT profile_id AS id, body FROM me),
  {sql_terms('src', 'd')}, {sql_terms('qsrc', 'q')}, {sql_vocabulary('src', 'd', CAP)}, {sql_unit('d_tf', 'dv')}, {sql_unit('q_tf', 'qv')},
  dots AS (SELECT q.id AS profile_id, d.id, sum(d.w * q.w) AS s FROM dv d JOIN qv q USING (term) GROUP BY ALL),
  factors AS (SELECT me.*, posting_id, arrival_seq, js, coalesce(s, 0) AS sim, list_filter(js, lambda x: list_contains(us, x)) AS matched,
    CASE WHEN len(js) = 0 THEN 0 ELSE len(list_filter(js, lambda x: list_contains(us, x))) / len(js) END AS raw_skill,
    CASE WHEN len(kws) = 0 THEN 0 ELSE len(list_filter(kws, lambda k: contains(blob, k))) / len(kws) END
      + CASE WHEN named AND contains(tmatch, rkey) THEN 0.3 ELSE 0 END AS raw_role
    FROM me CROSS JOIN blobs LEFT JOIN dots ON dots.profile_id = me.profile_id AND dots.id = posting_id),
  scored AS (SELECT *, CASE WHEN len(js) < 4 AND raw_skill > 0.5 THEN 0.5 ELSE raw_skill END AS skill, least(1.0, raw_role) AS fit FROM factors),
  finals AS (SELECT *, least(1.0, w1 * sim + w2 * skill + w3 * fit) AS total FROM scored)
  SELECT profile_id, posting_id, row_number() OVER w AS rank, round(total, 6) AS final_score, round(sim, 6) AS nlp_score, round(skill, 6) AS skill_score,
    round(fit, 6) AS role_score, array_to_string(matched, '|') AS matched FROM finals WHERE total > 0
  WINDOW w AS (PARTITION BY profile_id ORDER BY round(total, 6) DESC, arrival_seq) QUALIFY row_number() OVER w <= 10"""


@query("plan_search_many", SQL_SEARCH_MANY)
def plan_many(spark, sf):
    """The ten best postings of every profile."""
    vocab = vocabulary(spark)
    found = search_many(postings(spark, sf), profiles(spark, sf), SkillExtractor(spark, vocab, CUES), vocab, 10, OPTIONS)
    return found.withColumn("matched", T.join_list(F.col("matched_skills"), "|")).drop("matched_skills")


_ORDERS = {
    "best": ("Best Match", "final_score DESC"),
    "skills": ("Skills Match", "skill_score DESC"),
    "role": ("Role Match", "role_score DESC"),
    "title": ("Job Title (A-Z)", "job_title ASC"),
    "company": ("Company (A-Z)", "company ASC"),
}


def _register_order(key, option, order):
    sql = f"{SQL_SEARCH} SELECT posting_id, row_number() OVER (ORDER BY {order}, arrival_seq) AS rank FROM results"

    @query(f"w1_w5_rank_{key}", sql)
    def ranked(spark, sf):
        return S.ranked(results(spark, sf, "posting_id", "arrival_seq", W.SORT_COLUMNS[option]), S.SearchOptions(sort=option))


for _key, (_option, _order) in _ORDERS.items():
    _register_order(_key, _option, _order)


_DOC_ORDER = "n_chars DESC, doc_id"


@query(
    "w5_rank_all_documents",
    f"SELECT doc_id, lang, row_number() OVER (ORDER BY {_DOC_ORDER}) AS rank FROM documents",
)
def w5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return W.with_rank(docs, [F.col("n_chars").desc(), F.col("doc_id")]).drop("n_chars")


@query(
    "w5_rank_per_group",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem",
)
def w5_group(spark, sf):
    """Three groups hold all rows, and a third of them share few order values."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    order = [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return W.with_rank(lines, order, group="l_returnflag").select("l_orderkey", "l_linenumber", "rank")


@query(
    "w2_top_per_profile",
    f"""WITH {SQL_PAIRS} SELECT item_id, doc_id, similarity, rank FROM (SELECT *, row_number() OVER
      (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM pairs) WHERE rank <= 10""",
)
def w2(spark, sf):
    return V.best_pairs(docs(spark, sf), profile_terms(spark, sf), "doc_id", "item_id", 10, CAP, digits=6)


@query("w2_top_events", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def w2_events(spark, sf):
    order = [F.col("value").desc(), F.col("event_id").asc()]
    return W.top_k(table(spark, sf, "events").select("event_id", "value"), order, 10)


def _sql_page(page, size):
    return f"""WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
      b AS (SELECT least({page}, greatest(1, ceil(count(*) / {size}))) AS p FROM ranked)
      SELECT o_orderkey, rank FROM ranked, b WHERE rank > (p - 1) * {size} AND rank <= p * {size}"""


def _page(spark, sf, page, size):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ranked = W.with_rank(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return W.result_page(ranked, page, size).select("o_orderkey", "rank")


@query("w3_page", _sql_page(3, 25))
def w3(spark, sf):
    return _page(spark, sf, 3, 25)


@query("w3_page_past_end", _sql_page(10_000_000, 20))
def w3_end(spark, sf):
    return _page(spark, sf, 10_000_000, 20)


@query(
    "w6_head_items",
    f"SELECT doc_id, array_to_string(list_slice(string_split({sql_norm('text')}, ' '), 1, 15), ' ') AS head FROM documents",
)
def w6(spark, sf):
    words = F.split(T.normalize(F.col("text")), " ")
    return table(spark, sf, "documents").select(
        "doc_id", T.join_list(W.head_items(words, 15), " ").alias("head")
    )


# --- market summary of the ranked results -----------------------------------------------------


@query("a1_top_titles", f"{SQL_SEARCH} SELECT job_title, count(*) AS n FROM results GROUP BY 1 ORDER BY n DESC, job_title LIMIT 5")
def a1(spark, sf):
    return M.value_counts(results(spark, sf, "job_title"), "job_title", 5)


@query("a2_top_companies", f"{SQL_SEARCH} SELECT company, count(*) AS n FROM results GROUP BY 1 ORDER BY n DESC, company LIMIT 5")
def a2(spark, sf):
    return M.value_counts(results(spark, sf, "company"), "company", 5)


@query("a3_industries", f"{SQL_SEARCH} SELECT industry, count(*) AS n FROM results GROUP BY 1")
def a3(spark, sf):
    return M.value_counts(results(spark, sf, "industry"), "industry")


@query("a4_levels", f"{SQL_SEARCH} SELECT job_level_norm, count(*) AS n FROM results GROUP BY 1")
def a4(spark, sf):
    return M.value_counts(results(spark, sf, "job_level_norm"), "job_level_norm")


def _sql_gap(order):
    return f"""{SQL_SEARCH}, first AS (SELECT * FROM results ORDER BY {order}, arrival_seq LIMIT 25)
      SELECT skill, count(*) AS n FROM (SELECT unnest(missing) AS skill FROM first) GROUP BY 1 ORDER BY n DESC, skill LIMIT 10"""


@query("a6_w4_skill_gap", _sql_gap("final_score DESC"))
def a6(spark, sf):
    return M.skill_gap(results(spark, sf, "arrival_seq", "final_score", "missing_skills"), W.sort_keys("Best Match"))


@query("a6_skill_gap_by_title", _sql_gap("job_title ASC"))
def a6_title(spark, sf):
    return M.skill_gap(results(spark, sf, "arrival_seq", "job_title", "missing_skills"), W.sort_keys("Job Title (A-Z)"))


@query("a7_salary", f"{SQL_SEARCH} SELECT round(avg(salary_min), 6) AS avg_min, round(avg(salary_max), 6) AS avg_max FROM results")
def a7(spark, sf):
    return M.salary_means(results(spark, sf, "salary_min", "salary_max")).select(
        F.round("avg_min", 6).alias("avg_min"), F.round("avg_max", 6).alias("avg_max")
    )


@query("a8_top_score", f"{SQL_SEARCH} SELECT max(final_score) AS top_score FROM results")
def a8(spark, sf):
    return M.top_score(results(spark, sf, "final_score"))


@query("a9_row_count", f'{SQL_SEARCH} SELECT count(*) AS "rows" FROM results')
def a9(spark, sf):
    return M.row_count(results(spark, sf, "posting_id"))


@query(
    "c13_funnel",
    f"""WITH {P_CTE}, {SQL_DEDUP} SELECT count(*) AS fetched, count(*) FILTER ({SQL_DIRECT}) AS cleaned,
      count(*) FILTER ({_FILTER}) AS analyzed FROM unique_postings""",
)
def c13(spark, sf):
    rows = S.flagged(postings(spark, sf), vocabulary(spark), OPTIONS)
    return M.funnel(rows, S.funnel_counts(rows))


@query(
    "s9_export",
    f"""{SQL_SEARCH} SELECT job_title, company, job_location, work_mode, industry, employment_type_norm, job_level_norm, job_skills,
      final_score, nlp_score, skill_score, role_score, salary_min, salary_max, job_link FROM results""",
)
def s9(spark, sf):
    return export_columns(results(spark, sf))


SQL_RESCORED = f"""{SQL_SEARCH}, page_main AS MATERIALIZED ({SQL_MAIN} SELECT page_id, text FROM main WHERE text <> ''),
  link_text AS (SELECT job_link, first(text ORDER BY length(text) DESC, text DESC) AS page_text
    FROM page_main JOIN postings ON posting_id = page_id GROUP BY job_link),
  fuller AS MATERIALIZED (SELECT posting_id, job_title, page_text FROM kept JOIN link_text USING (job_link)
    WHERE length(page_text) > length(coalesce(job_description, '')) + 50),
  ftexts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM
    (SELECT posting_id AS id, job_title || chr(10) || page_text AS raw FROM fuller)),
  {sql_posting_skills('ftexts', 'f')},
  fresh AS (SELECT posting_id, page_text, coalesce(list(skill ORDER BY skill) FILTER (skill IS NOT NULL), []) AS fjs
    FROM fuller LEFT JOIN fgated ON fgated.id = posting_id GROUP BY 1, 2),
  again AS (SELECT f.posting_id, f.tmatch, sim, us, w1, w2, w3, n.posting_id IS NOT NULL AS used,
    CASE WHEN n.posting_id IS NULL THEN js ELSE fjs END AS js,
    CASE WHEN n.posting_id IS NULL THEN f.blob ELSE {sql_match("job_title || ' ' || page_text")} END AS blob
    FROM factors f LEFT JOIN fresh n ON n.posting_id = f.posting_id),
  refit AS (SELECT *, {sql_hits(_RK)} AS hits, list_filter(js, lambda x: list_contains(us, x)) AS matched,
    CASE WHEN len(js) = 0 THEN 0 ELSE len(list_filter(js, lambda x: list_contains(us, x))) / len(js) END AS raw_skill FROM again),
  rescored AS (SELECT *, CASE WHEN len(js) < 4 AND raw_skill > 0.5 THEN 0.5 ELSE raw_skill END AS skill,
    len(js) < 4 AND raw_skill > 0.5 AS capped,
    least(1.0, len(hits) / {len(_RK)} + CASE WHEN contains(tmatch, 'of the') THEN 0.3 ELSE 0 END) AS fit FROM refit)"""


@query(
    "r7_rescore",
    f"""{SQL_RESCORED} SELECT posting_id, used AS used_full_desc, array_to_string(js, '|') AS skills, array_to_string(matched, '|') AS matched,
      array_to_string(hits, '|') AS hits, round(sim, 6) AS nlp_score, round(skill, 6) AS skill_score, round(fit, 6) AS role_score,
      round(least(1.0, w1 * sim + w2 * skill + w3 * fit), 6) AS final_score,
      capped OR len(js) < 4 AS few_skills, NOT used AND len(js) < 8 AS snippet_unreliable FROM rescored""",
)
def rescored(spark, sf):
    """Search, then the main texts of the postings' own pages, then the scores again where a page adds enough."""
    vocab = vocabulary(spark)
    people, extractor, rows = profiles(spark, sf), SkillExtractor(spark, vocab, CUES), postings(spark, sf)
    found = S.search(rows, people, extractor, vocab, OPTIONS, PROFILE, S.RESCORE_COLUMNS)

    def texts(wanted):
        """Main texts of the pages of the wanted links."""
        links = staged(rows.join(wanted, "job_link", "left_semi").select("job_link", F.col("posting_id").alias("page_id")), "pages")
        pages = table(spark, sf, "pages").join(links, "page_id", "left_semi")
        return page_texts(extract_pages(pages).join(links, "page_id"))

    again = S.rescore(rows, found, texts, people, extractor, vocab, PROFILE)
    return again.select(
        "posting_id", "used_full_desc", "few_skills", "snippet_unreliable",
        T.join_list(F.col("expanded_job_skills"), "|").alias("skills"),
        T.join_list(F.col("matched_skills"), "|").alias("matched"),
        T.join_list(F.col("role_hits"), "|").alias("hits"),
        *[F.round(c, 6).alias(c) for c in ("nlp_score", "skill_score", "role_score", "final_score")],
    )
