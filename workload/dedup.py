"""Deduplication over the postings view, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import keep_first_by_prefix
from roleweave.operators import dedup as D
from workload.common import P_CTE, postings, query, sql_key, table

SQL_DEDUP = f"""keyed AS (SELECT *, coalesce(nullif(lower(coalesce(job_link, '')), ''), concat('no link ', arrival_seq)) AS link_key, {sql_key('job_title')} AS k1,
    {sql_key('company')} AS k2, {sql_key('job_location')} AS k3 FROM postings),
  pass_a AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY arrival_seq) = 1),
  unique_postings AS (SELECT * FROM pass_a QUALIFY row_number() OVER (PARTITION BY k1, k2, k3 ORDER BY arrival_seq) = 1)"""


@query("d1_dedup_two_pass", f"WITH {P_CTE}, {SQL_DEDUP} SELECT posting_id, job_title, company FROM unique_postings")
def d1(spark, sf):
    return D.deduplicate_postings(postings(spark, sf)).select("posting_id", "job_title", "company")


@query(
    "d1_dedup_hot_key",
    f"""WITH {P_CTE.replace("concat('https://www.', source, '.example.com/', md5(text)) AS job_link",
        "CASE WHEN lang = 'en' THEN '' ELSE concat('https://www.', source, '.example.com/', md5(text)) END AS job_link")},
    {SQL_DEDUP} SELECT posting_id FROM unique_postings""",
)
def d1_hot(spark, sf):
    """More than half of the postings have no link; each is compared by its triple alone."""
    p = postings(spark, sf)
    return D.deduplicate_postings(
        p.withColumn("job_link", F.when(F.col("job_location") == "en", "").otherwise(F.col("job_link")))
    ).select("posting_id")


@query(
    "d2_keep_first",
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def d2(spark, sf):
    return D.keep_first(table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id", "source")


@query("d3_distinct_rows", "SELECT DISTINCT event_type, user_id, props FROM events")
def d3(spark, sf):
    return D.drop_repeats(table(spark, sf, "events").select("event_type", "user_id", "props"))


@query(
    "d4_block_dedup",
    """SELECT doc_id, count(*) AS n_blocks, string_agg(block, chr(10) ORDER BY i) AS kept FROM (
      SELECT doc_id, u.i, u.block FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(block, i)
      QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY i) = 1) GROUP BY doc_id""",
)
def d4(spark, sf):
    kept = table(spark, sf, "documents").withColumn(
        "kept", keep_first_by_prefix(F.split("text", "\n"))
    )
    return kept.select(
        "doc_id", F.size("kept").cast("long").alias("n_blocks"), T.join_list(F.col("kept"), "\n").alias("kept")
    )
