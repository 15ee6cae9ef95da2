"""Filters and classifiers over the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.operators import classify as C
from roleweave.operators import market as M
from workload.common import (
    INDUSTRY_RULES, P_CTE, QUALITY_RULES, postings, query, sql_match, sql_norm, table, vocabulary,
)


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


SQL_DIRECT = f"""(lower({sql_norm('job_link')}) <> ''
  AND NOT {sql_any("lower(replace(regexp_extract(lower(job_link), '^(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#]*)', 1), 'www.', ''))", QUALITY_RULES['domain'])}
  AND NOT {sql_any(f"lower({sql_norm('job_title')})", QUALITY_RULES['title'])}
  AND NOT {sql_any(f"(lower({sql_norm('job_title')}) || ' ' || lower({sql_norm('job_description')}))", QUALITY_RULES['text'])})"""

_BLOB = f"blobs AS MATERIALIZED (SELECT *, {sql_match("job_title || ' ' || job_description")} AS blob, {sql_match("contract_type || ' ' || contract_time || ' ' || job_title || ' ' || job_description")} AS tblob FROM postings)"
SQL_INDUSTRY = "CASE " + " ".join(
    f"WHEN {sql_any('blob', kws)} THEN '{label}'" for label, kws in INDUSTRY_RULES.items()
) + " ELSE 'Other' END"
SQL_MODE = f"CASE WHEN {sql_any('blob', ['remote', 'work from home', 'wfh'])} THEN 'Remote' WHEN contains(blob, 'hybrid') THEN 'Hybrid' ELSE 'Onsite' END"
SQL_LEVEL = f"""CASE WHEN {sql_any('blob', ['intern', 'internship'])} THEN 'Intern'
  WHEN {sql_any('blob', ['entry', 'junior', 'jr ', 'new grad', 'recent graduate'])} THEN 'Entry'
  WHEN {sql_any('blob', ['senior', ' lead ', 'principal', 'director', 'manager'])} THEN 'Senior' ELSE 'Mid' END"""
SQL_TYPE = f"""CASE WHEN {sql_any('tblob', ['intern', 'internship'])} THEN 'Internship'
  WHEN {sql_any('tblob', ['part-time', 'part time'])} OR contract_time = 'part_time' THEN 'Part-time'
  WHEN {sql_any('tblob', ['contract', 'temporary'])} OR contract_type = 'contract' THEN 'Contract'
  WHEN {sql_any('tblob', ['full-time', 'full time'])} OR contract_time = 'full_time' THEN 'Full-time' ELSE 'Other' END"""


@query("c1_direct_employer", f"WITH {P_CTE} SELECT posting_id, {SQL_DIRECT} AS direct FROM postings")
def c1(spark, sf):
    direct = C.direct_employer(F.col("job_link"), F.col("job_description"), F.col("job_title"), vocabulary(spark))
    return postings(spark, sf).select("posting_id", direct.alias("direct"))


@query("c2_industry", f"WITH {P_CTE}, {_BLOB} SELECT posting_id, {SQL_INDUSTRY} AS industry FROM blobs")
def c2(spark, sf):
    p = postings(spark, sf).withColumn("m", C.spaced_match(F.col("job_title"), F.col("job_description")))
    return p.select("posting_id", C.industry(F.col("m"), vocabulary(spark)).alias("industry"))


@query(
    "c3_work_mode",
    f"""SELECT conv_id, turn, CASE WHEN {sql_any('t', ['remote', 'work from home', 'wfh'])} THEN 'Remote'
    WHEN contains(t, 'hybrid') THEN 'Hybrid' ELSE 'Onsite' END AS mode FROM (SELECT conv_id, turn, {sql_match(
        "(CASE conv_id % 3 WHEN 0 THEN 'Work/From HOME' WHEN 1 THEN role ELSE 'Hybrid&x' END) || ' ' || text || ' ' || (CASE turn % 4 WHEN 1 THEN 'WFH' ELSE '' END)")} AS t FROM conversations)""",
)
def c3(spark, sf):
    kind = F.when(F.col("conv_id") % 3 == 0, "Work/From HOME").when(F.col("conv_id") % 3 == 1, F.col("role")).otherwise("Hybrid&x")
    tail = F.when(F.col("turn") % 4 == 1, "WFH").otherwise("")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", C.work_mode(C.spaced_match(kind, F.col("text"), tail)).alias("mode")
    )


@query(
    "c4_career_level",
    f"""SELECT o_orderkey, {SQL_LEVEL.replace('blob', 't')} AS level FROM (SELECT o_orderkey, {sql_match(
        "o_orderpriority || ' ' || (CASE o_custkey % 6 WHEN 0 THEN 'Internal' WHEN 1 THEN 'Jr (x)' WHEN 2 THEN 'the Lead of' WHEN 3 THEN 'MANAGER/x' WHEN 4 THEN 'lead' ELSE o_orderstatus END)")} AS t FROM orders)""",
)
def c4(spark, sf):
    k = F.col("o_custkey") % 6
    word = (
        F.when(k == 0, "Internal").when(k == 1, "Jr (x)").when(k == 2, "the Lead of").when(k == 3, "MANAGER/x")
        .when(k == 4, "lead").otherwise(F.col("o_orderstatus"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", C.career_level(C.spaced_match(F.col("o_orderpriority"), word)).alias("level")
    )


@query(
    "c2_c5_all_classes",
    f"""WITH {P_CTE}, {_BLOB} SELECT posting_id, {SQL_INDUSTRY} AS industry, {SQL_MODE} AS work_mode,
    {SQL_LEVEL} AS job_level_norm, {SQL_TYPE} AS employment_type_norm FROM blobs""",
)
def classes(spark, sf):
    return C.add_classes(C.with_matching(postings(spark, sf)), vocabulary(spark)).select(
        "posting_id", "industry", "work_mode", "job_level_norm", "employment_type_norm"
    )


@query("c5_employment_type", f"WITH {P_CTE}, {_BLOB} SELECT employment_type_norm, count(*) AS n FROM (SELECT {SQL_TYPE} AS employment_type_norm FROM blobs) GROUP BY 1")
def c5(spark, sf):
    return M.value_counts(C.add_classes(C.with_matching(postings(spark, sf)), vocabulary(spark)), "employment_type_norm")


@query(
    "c6_country",
    f"WITH {P_CTE} SELECT posting_id, coalesce(regexp_matches(lower(search_country), 'united states|usa|us'), false) AS home FROM postings",
)
def c6(spark, sf):
    return postings(spark, sf).select("posting_id", C.in_country(F.col("search_country")).alias("home"))


@query(
    "c7_facets",
    f"WITH {P_CTE}, {_BLOB} SELECT posting_id, job_title FROM blobs WHERE {SQL_TYPE} = 'Contract' AND {SQL_INDUSTRY} = 'Latin'",
)
def c7(spark, sf):
    classed = C.add_classes(C.with_matching(postings(spark, sf)), vocabulary(spark))
    facets = {"employment_type_norm": "Contract", "industry": "Latin", "work_mode": "All"}
    return C.facet_filter(classed, facets).select("posting_id", "job_title")


@query(
    "c8_drop_incomplete",
    f"WITH {P_CTE} SELECT posting_id FROM postings WHERE search_country IS NOT NULL AND salary_min IS NOT NULL",
)
def c8(spark, sf):
    return C.drop_incomplete(postings(spark, sf), ["search_country", "salary_min"]).select("posting_id")


def _sql_keywords(include, exclude):
    return (
        f"(regexp_matches(lower(job_title), '{include}') OR regexp_matches(lower(job_description), '{include}')) "
        f"AND NOT regexp_matches(lower(job_title), '{exclude}')"
    )


@query(
    "c9_keywords_literal",
    f"WITH {P_CTE} SELECT posting_id FROM postings WHERE {_sql_keywords('data|c\\+\\+|licen|zu', 'the|der')}",
)
def c9(spark, sf):
    rules = vocabulary(spark).keyword_sets[1]
    match = C.keyword_match(F.col("job_title"), F.col("job_description"), rules)
    return postings(spark, sf).where(match).select("posting_id")


@query(
    "c10_keywords_pattern",
    f"WITH {P_CTE} SELECT posting_id FROM postings WHERE {_sql_keywords('pour|with ', 'et |and')}",
)
def c10(spark, sf):
    rules = vocabulary(spark).keyword_sets[2]
    match = C.keyword_match(F.col("job_title"), F.col("job_description"), rules, quote=False)
    return postings(spark, sf).where(match).select("posting_id")


_PROFILED = ("posting_id", "job_title", "search_country", "salary_min", "salary_max")


@query(
    "c11_null_profile",
    f"WITH {P_CTE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) FILTER ({c} IS NULL) AS \"nulls\" FROM postings"
        for c in _PROFILED
    ),
)
def c11(spark, sf):
    return M.null_profile(postings(spark, sf).select(*_PROFILED)).select("column", "rows", "nulls")


@query(
    "c12_drop_empty",
    f"WITH {P_CTE} SELECT posting_id FROM postings WHERE salary_min IS NOT NULL OR salary_max IS NOT NULL",
)
def c12(spark, sf):
    return C.drop_empty(postings(spark, sf), ["salary_min", "salary_max"]).select("posting_id")
