"""Profiles built from the benchmark, documents and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators import profiles as P
from roleweave.operators.skills import SkillExtractor
from workload.common import CUES, S, VOCAB_CTE, query, sql_match, sql_norm, table, vocabulary
from workload.skills import (
    _KNOWN, sql_acronyms, sql_colons, sql_gate, sql_letters, sql_requirements, sql_scan, sql_valid,
)

SECTIONS = {
    "skills_text": r"(the|of the|que)(.*?)(with|and|und|$)",
    "experience_text": r"(for|pour la|pour|und)(.*?)(the|les|die|$)",
    "summary_text": r"(license|data|thre)(.*?)(er|$)",
}


@query(
    "p1_sections",
    "SELECT doc_id, "
    + ", ".join(
        f"{sql_norm(f'''regexp_extract(low, '(?is){p}', 2)''')} AS {n}" for n, p in SECTIONS.items()
    )
    + f" FROM (SELECT doc_id, lower({sql_norm('text')}) AS low FROM documents)",
)
def p1(spark, sf):
    sections = P.resume_sections(F.col("text"), SECTIONS)
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in sections.items()])


RAW_PROFILES = """raw_profiles AS (SELECT item_id AS profile_id,
  CASE item_id % 4 WHEN 0 THEN 'of the' WHEN 1 THEN ' Les Avec ' WHEN 2 THEN 'the thre le' ELSE '' END AS role,
  replace(text, ' ', ' ; ') AS typed_skills, text AS resume_text,
  (item_id % 3) * 0.5::DOUBLE AS w_profile, (item_id % 2) * 0.25::DOUBLE AS w_skill, (item_id % 3) * 1.0::DOUBLE AS w_role
  FROM benchmark)"""


def raw_profiles(spark, sf):
    k = F.col("item_id") % 4
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("profile_id"),
        F.when(k == 0, "of the").when(k == 1, " Les Avec ").when(k == 2, "the thre le").otherwise("").alias("role"),
        F.replace("text", F.lit(" "), F.lit(" ; ")).alias("typed_skills"),
        F.col("text").alias("resume_text"),
        ((F.col("item_id") % 3) * F.lit(0.5)).alias("w_profile"),
        ((F.col("item_id") % 2) * F.lit(0.25)).alias("w_skill"),
        ((F.col("item_id") % 3) * F.lit(1.0)).alias("w_role"),
    )


_CLEANED = f"""texts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM (SELECT id,
  regexp_replace(regexp_replace(raw, 'https?://[^{S[1:-1]}]+', ' ', 'g'), 'www\\.[^{S[1:-1]}]+', ' ', 'g') AS raw FROM (
    SELECT profile_id AS id, typed_skills AS raw FROM raw_profiles UNION ALL
    SELECT profile_id, resume_text FROM raw_profiles)))"""

SQL_PROFILE_SKILLS = f"""{_CLEANED}, {sql_scan('texts', 'scan')}, {sql_acronyms('texts', 'acr')},
  {sql_letters('texts', 'letters')}, {sql_requirements('texts', 'req')}, {sql_colons('texts', 'col')},
  every AS (SELECT * FROM scan UNION SELECT * FROM acr UNION SELECT * FROM letters UNION SELECT * FROM req UNION SELECT * FROM col),
  {sql_gate('every', 'gated')},
  typed AS (SELECT profile_id AS id, lower(regexp_replace(unnest(regexp_split_to_array(typed_skills, '[,;|]')), '^{S}+|{S}+$', '', 'g')) AS token FROM raw_profiles),
  typed_named AS (SELECT t.id, coalesce(a.canonical, t.token) AS skill FROM typed t LEFT JOIN alias a ON a.variant = t.token WHERE token <> ''),
  united AS (SELECT * FROM gated UNION SELECT id, skill FROM typed_named WHERE {sql_valid('skill')}),
  renamed AS (SELECT DISTINCT u.id, coalesce(a.canonical, u.skill) AS skill FROM united u LEFT JOIN alias a ON a.variant = u.skill),
  profile_skill AS (SELECT id, skill FROM renamed WHERE {sql_valid('skill')})"""


def profiles(spark, sf):
    vocab = vocabulary(spark)
    return P.build_profiles(raw_profiles(spark, sf), SkillExtractor(spark, vocab, CUES), vocab, SECTIONS)


_P2 = f"WITH {VOCAB_CTE}, {_KNOWN}, {RAW_PROFILES}, {SQL_PROFILE_SKILLS}"


@query(
    "p2_profile_skills",
    f"{_P2} SELECT id AS profile_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM profile_skill GROUP BY id",
)
def p2(spark, sf):
    return profiles(spark, sf).select("profile_id", T.join_list(F.col("skills"), "|").alias("skills"))


def _sql_section(name):
    inner = f"regexp_extract(lower({sql_norm('resume_text')}), '(?is){SECTIONS[name]}', 2)"
    return sql_norm(inner)


@query(
    "p3_p5_focus_and_query_text",
    f"""{_P2}, listed AS (SELECT id, array_to_string(list(skill ORDER BY skill), ' ') AS skills FROM profile_skill GROUP BY id),
    focus AS (SELECT profile_id, role, {sql_norm(f"concat(role, ' ', coalesce(skills, ''), ' ', {_sql_section('summary_text')}, ' ', {_sql_section('experience_text')})")} AS focus_text
      FROM raw_profiles LEFT JOIN listed ON id = profile_id)
    SELECT profile_id, focus_text, coalesce(nullif(focus_text, ''), {sql_norm('role')}) AS query_text FROM focus""",
)
def p3(spark, sf):
    return profiles(spark, sf).select("profile_id", "focus_text", "query_text")


@query(
    "p4_weights",
    """SELECT p_partkey, round(CASE WHEN t = 0 THEN 0.2 ELSE a / t END, 6) AS w_profile,
      round(CASE WHEN t = 0 THEN 0.5 ELSE b / t END, 6) AS w_skill, round(CASE WHEN t = 0 THEN 0.3 ELSE c / t END, 6) AS w_role
      FROM (SELECT *, a + b + c AS t FROM (SELECT p_partkey, (p_size % 3) * 0.25::DOUBLE AS a, (p_partkey % 2) * 0.5::DOUBLE AS b,
        (p_size % 2) * 1.0::DOUBLE AS c FROM part))""",
)
def p4(spark, sf):
    weights = P.normalized_weights(
        (F.col("p_size") % 3) * F.lit(0.25), (F.col("p_partkey") % 2) * F.lit(0.5), (F.col("p_size") % 2) * F.lit(1.0)
    )
    return table(spark, sf, "part").select("p_partkey", weights.alias("w")).select(
        "p_partkey", *[F.round(f"w.{n}", 6).alias(n) for n in ("w_profile", "w_skill", "w_role")]
    )
