"""Landed pages, posting lists and the posting stream, derived from documents and part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.plans import matching as N
from roleweave.operators import dedup as D
from roleweave.operators.rank import with_rank
from roleweave.session import ensure_checkpoint_dir
from roleweave.staging import staged
from roleweave.sources import postings as P
from roleweave.sources.sinks import write_csv
from roleweave.streaming import ingest as I
from workload.common import P_CTE, postings, query, sql_norm, table, vocabulary
from workload.dedup import SQL_DEDUP
from workload.scoring import QUERY_TEXT, sql_terms, sql_unit, sql_vocabulary

_PER_SEARCH, _PER_PAGE = 200, 10


def landed(spark, sf, whole=False):
    """One JSON text per (search, page): ten documents a page; unless ``whole``, some pages failed, some empty."""
    d = table(spark, sf, "documents")
    named = F.to_json(F.struct(F.col("source").alias("display_name")))
    place = F.to_json(F.struct(F.col("lang").alias("display_name")))
    posting = F.struct(
        (F.col("doc_id") % _PER_PAGE).alias("pos"),
        F.col("text").alias("title"),
        F.concat(F.lit(" "), "text", F.lit("\n")).alias("description"),
        F.md5("text").alias("redirect_url"),
        F.when(F.col("lang") == "es", F.col("source")).when(F.col("lang") != "de", named).alias("company"),
        place.alias("location"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.col("lang") == "fr", "contract").alias("contract_type"),
        F.lit(" full_time ").alias("contract_time"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars").cast("double")).alias("salary_min"),
        F.col("n_chars").cast("double").alias("salary_max"),
    )
    grouped = d.groupBy(
        F.floor(F.col("doc_id") / _PER_SEARCH).alias("search"),
        (F.floor(F.col("doc_id") % _PER_SEARCH / _PER_PAGE) + 1).cast("int").alias("page"),
    ).agg(F.sort_array(F.collect_list(posting)).alias("results"))
    failed = (F.col("page") + F.col("search")) % 7 == 3
    empty = F.col("page") == 13 + F.col("search") % 6
    if whole:
        failed, empty = F.lit(False), F.lit(False)
    absent = failed & (F.col("page") % 2 == 0)
    results = F.when(empty, F.slice("results", 1, 0)).otherwise(F.col("results"))
    return grouped.where(~absent).select(
        "search", "page", failed.alias("failed"), F.to_json(F.struct("page", results.alias("results"))).alias("json")
    )


def parsed(spark, sf):
    """All landed pages; of the failed ones some are absent and some cut off."""
    text = F.when(F.col("failed"), F.expr("substring(json, 1, length(json) - 5)")).otherwise(F.col("json"))
    return landed(spark, sf).select("search", P.parse_pages(text).alias("p"), "page").select(
        "search", "page", "p.results", "p.corrupt"
    )


def usable(spark, sf):
    return P.usable_pages(parsed(spark, sf), "search")


_SQL_PAGES = f"""placed AS (SELECT *, doc_id // {_PER_SEARCH} AS search, (doc_id % {_PER_SEARCH}) // {_PER_PAGE} + 1 AS page,
    doc_id % {_PER_PAGE} AS pos FROM documents),
  landed AS (SELECT *, page = 13 + search % 6 AS empty FROM placed WHERE (page + search) % 7 <> 3),
  stops AS (SELECT search, min(page) AS stop FROM landed WHERE empty GROUP BY search),
  usable AS (SELECT l.* FROM landed l LEFT JOIN stops s ON s.search = l.search WHERE page < coalesce(stop, 1000000)),
  flat AS (SELECT *, concat(lpad(search::VARCHAR, 19, '0'), '/', lpad(page::VARCHAR, 19, '0'), '/', lpad(pos::VARCHAR, 19, '0')) AS arrival FROM placed)"""


@query(
    "s4_page_sequence",
    f"WITH {_SQL_PAGES} SELECT search, page, count(*) AS n FROM usable GROUP BY search, page",
)
def s4(spark, sf):
    return usable(spark, sf).select("search", "page", F.size("results").cast("long").alias("n"))


def _whole(spark, sf):
    """Every document as a posting of a page that landed well."""
    return landed(spark, sf, whole=True).select("search", P.parse_pages(F.col("json")).alias("p")).select("search", "p.*")


@query(
    "s2_flatten_pages",
    f"""WITH {_SQL_PAGES} SELECT search, arrival AS arrival_seq, arrival AS posting_id, {sql_norm('text')} AS job_title,
      CASE WHEN lang IN ('en', 'fr') THEN source ELSE '' END AS company, lang AS job_location, {sql_norm('text')} AS job_description,
      md5(text) AS job_link, '' AS category, CASE lang WHEN 'fr' THEN 'contract' ELSE '' END AS contract_type, 'full_time' AS contract_time,
      'United States' AS search_country, CASE WHEN doc_id % 5 <> 0 THEN n_chars::DOUBLE END AS salary_min, n_chars::DOUBLE AS salary_max,
      page AS source_page FROM flat""",
)
def s2(spark, sf):
    return P.flatten_pages(_whole(spark, sf), keep=("search",))


_NAMED = "'remote data scientist, full time / ' || search"


@query(
    "s2_flatten_named_searches",
    f"""WITH {_SQL_PAGES} SELECT {_NAMED} AS search, concat(replace({_NAMED}, '/', '%2F'), '/', lpad(page::VARCHAR, 19, '0'), '/', lpad(pos::VARCHAR, 19, '0')) AS posting_id,
      {sql_norm('text')} AS job_title, page AS source_page FROM flat""",
)
def s2_named(spark, sf):
    """Searches are folder names that begin alike."""
    pages = _whole(spark, sf).withColumn("search", F.concat(F.lit("remote data scientist, full time / "), "search"))
    return P.flatten_pages(pages, keep=("search",)).select("search", "posting_id", "job_title", "source_page")


@query(
    "ingest_named_to_unique",
    f"""WITH {_SQL_PAGES}, postings AS (SELECT concat(replace({_NAMED}, '/', '%2F'), '/', lpad(page::VARCHAR, 19, '0'), '/', lpad(pos::VARCHAR, 19, '0')) AS arrival_seq,
      {sql_norm('text')} AS job_title, CASE WHEN lang IN ('en', 'fr') THEN source ELSE '' END AS company, lang AS job_location, md5(text) AS job_link FROM flat),
      {SQL_DEDUP.replace('posting_id', 'arrival_seq')} SELECT arrival_seq, job_link FROM unique_postings""",
)
def named_to_unique(spark, sf):
    pages = _whole(spark, sf).withColumn("search", F.concat(F.lit("remote data scientist, full time / "), "search"))
    return D.deduplicate_postings(P.flatten_pages(pages, keep=("search",))).select("arrival_seq", "job_link")


_SQL_REDUCED = """text AS job_title, CASE WHEN lang IN ('en', 'fr') THEN source END AS company, lang AS job_location,
  chr(160) || text || chr(10) AS job_description, md5(text) AS job_link, '' AS job_skills, 'United States' AS search_country, '' AS job_level, '' AS job_type"""


@query("s3_flatten_reduced", f"WITH {_SQL_PAGES} SELECT {_SQL_REDUCED} FROM flat WHERE lang IN ('en', 'fr')")
def s3(spark, sf):
    """All landed postings; those without a company name are rejected."""
    return P.accepted(P.flatten_reduced(_whole(spark, sf)))


@query(
    "s3_rejected",
    f"""WITH {_SQL_PAGES} SELECT search, page, pos, {_SQL_REDUCED}, 'company without display_name' AS reason FROM flat
      WHERE lang NOT IN ('en', 'fr')""",
)
def s3_rejected(spark, sf):
    return P.rejected(P.flatten_reduced(_whole(spark, sf), keep=("search",)))


@query(
    "ingest_landed_to_unique",
    f"""WITH {_SQL_PAGES}, postings AS (SELECT arrival AS arrival_seq, arrival AS posting_id, {sql_norm('text')} AS job_title,
      CASE WHEN lang IN ('en', 'fr') THEN source ELSE '' END AS company, lang AS job_location, md5(text) AS job_link
      FROM flat JOIN (SELECT search, page FROM usable GROUP BY ALL) USING (search, page)), {SQL_DEDUP}
      SELECT posting_id, job_link FROM unique_postings""",
)
def landed_to_unique(spark, sf):
    """Landed pages, the page rule, one row per posting, two-pass deduplication."""
    rows = P.flatten_pages(usable(spark, sf), keep=("search",))
    return D.deduplicate_postings(rows).select("posting_id", "job_link")


@query(
    "u4_accumulate",
    "SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents",
)
def u4(spark, sf):
    first = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return first.unionByName(table(spark, sf, "documents").select("text", "doc_id"))


_SQL_LIST = f"""raw AS (SELECT p_partkey AS arrival_seq, '  ' || p_type || ' ' || chr(160) || p_name AS job_title, p_brand AS company,
    p_type || '-' || p_size || '-' || p_partkey % 40 AS job_link, p_name || chr(10) || p_type AS job_summary,
    CASE p_size % 6 WHEN 0 THEN ' ' ELSE replace(p_name, ' ', ', ') || ',' || upper(p_type) END AS job_skills FROM part),
  clean AS (SELECT arrival_seq, {sql_norm('job_title')} AS job_title, company, job_link, {sql_norm('job_summary')} AS job_description,
    nullif({sql_norm('job_skills')}, '') AS job_skills FROM raw),
  kept AS MATERIALIZED (SELECT * FROM clean WHERE job_skills IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY arrival_seq) = 1)"""


def _listings(spark, sf):
    skills = F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(","), F.upper("p_type"))
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("arrival_seq"),
        F.concat(F.lit("  "), "p_type", F.lit("  "), "p_name").alias("job_title"),
        F.col("p_brand").alias("company"),
        F.concat_ws("-", "p_type", "p_size", F.col("p_partkey") % 40).alias("job_link"),
        F.concat("p_name", F.lit("\n"), "p_type").alias("job_summary"),
        F.when(F.col("p_size") % 6 == 0, " ").otherwise(skills).alias("job_skills"),
    )
    return N.clean_postings(raw)


_MINE = ["small", "ring", "economy", "red"]
_SQL_MINE = "['small', 'ring', 'economy', 'red']"


@query(
    "plan_clean_and_match",
    f"""WITH {_SQL_LIST}, listed AS (SELECT *, list_transform(string_split(job_skills, ','), lambda x: lower(trim(x))) AS js FROM kept)
      SELECT arrival_seq, job_title, concat(job_title, ' ', job_description, ' ', job_skills) AS job_text, round(len(list_filter(list_distinct(js), lambda x: list_contains({_SQL_MINE}, x))) / len(list_distinct(js)), 6) AS skill_score,
      array_to_string(list_sort(list_filter(list_distinct(js), lambda x: list_contains({_SQL_MINE}, x))), '|') AS matched FROM listed""",
)
def plan_match(spark, sf):
    return N.match_skills(_listings(spark, sf), _MINE).select(
        "arrival_seq", "job_title", "job_text", F.round("skill_score", 6).alias("skill_score"),
        T.join_list(F.col("matched_skills"), "|").alias("matched"),
    )


@query(
    "plan_match_text_top",
    f"""WITH {P_CTE}, src AS (SELECT arrival_seq AS id, concat(job_title, ' ', job_description, ' ') AS body FROM postings),
      qsrc AS (SELECT 0 AS id, '{QUERY_TEXT}' AS body), {sql_terms('src', 'd', False)}, {sql_terms('qsrc', 'q', False)},
      {sql_vocabulary('src', 'd', None)}, {sql_unit('d_tf', 'dv')}, {sql_unit('q_tf', 'qv')}
      SELECT arrival_seq, similarity FROM (SELECT d.id AS arrival_seq, round(sum(d.w * q.w), 6) AS similarity FROM dv d JOIN qv q USING (term) GROUP BY d.id)
      ORDER BY similarity DESC, arrival_seq LIMIT 10""",
)
def plan_match_text(spark, sf):
    p = postings(spark, sf).select(
        "arrival_seq",
        T.join_fields(" ", F.col("job_title"), F.col("job_description"), F.lit("")).alias("job_text"),
    )
    found = N.match_text(p, QUERY_TEXT, vocabulary(spark)).withColumn("similarity", F.round("similarity", 6))
    return N.best(found, "similarity", 10)


@query(
    "plan_a5_subset_top_titles",
    f"""WITH {P_CTE} SELECT job_title, count(*) AS n FROM postings WHERE (regexp_matches(lower(job_title), 'pour|with ')
      OR regexp_matches(lower(job_description), 'pour|with ')) AND NOT regexp_matches(lower(job_title), 'et |and')
      GROUP BY 1 ORDER BY n DESC, job_title LIMIT 20""",
)
def a5(spark, sf):
    from roleweave.operators.market import value_counts

    subset = N.keyword_subset(postings(spark, sf), vocabulary(spark).keyword_sets[2], quote=False)
    return value_counts(subset, "job_title", 20)


@query("s11_stream_ingest", f"WITH {P_CTE}, {SQL_DEDUP} SELECT posting_id, job_title FROM unique_postings")
def s11(spark, sf):
    """The documents as a file stream; the table it leaves equals the batch deduplication."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    # A pattern matches one file as well as a folder of them; a plain path has to be a folder.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{{documents.parquet}}")
    # The one file is one task; a landing folder of many files needs no such step.
    rows = _as_postings(stream.repartition(spark.sparkContext.defaultParallelism))
    I.ingest(rows, f"{base}/table", f"{base}/progress").awaitTermination()
    return I.read_ingested(spark, f"{base}/table").select("posting_id", "job_title")


@query("s11_stream_batches", f"WITH {P_CTE}, {SQL_DEDUP} SELECT posting_id, job_title FROM unique_postings")
def s11_batches(spark, sf):
    """Nine landed files, one batch each, keys merged into runs of three batches and of nine."""
    base = _folder(spark, "batches")
    # Written once by all tasks: each landing file is then one task's copy of narrow rows.
    rows = staged(_as_postings(table(spark, sf, "documents")), "arrivals")
    low, high = rows.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    if low is None:
        return rows.select("posting_id", "job_title")
    step = (high - low) // 9 + 1
    for at in range(low, high + 1, step):  # files land in arrival order
        part = rows.where((F.col("arrival_seq") >= at) & (F.col("arrival_seq") < at + step))
        part.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    settings = I.KeySettings(merge_every=3, bucket_keys=64)
    I.ingest(stream, f"{base}/table", f"{base}/progress", settings=settings).awaitTermination()
    return I.read_ingested(spark, f"{base}/table").select("posting_id", "job_title")


def _as_postings(d):
    return d.select(
        F.col("doc_id").alias("posting_id"),
        F.col("doc_id").alias("arrival_seq"),
        T.first_words(F.col("text"), 2).alias("job_title"),
        F.col("source").alias("company"),
        F.col("lang").alias("job_location"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.md5("text")).alias("job_link"),
    )




# --- files written and read back ---------------------------------------------------------------


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_CSV_TEXT = "nullif(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '')"
_SQL_CSV = f"""SELECT md5(text) AS job_link, source || ', "' || lang || '"' AS job_title, source AS company, lang AS job_location,
  CAST(doc_id AS VARCHAR) AS first_seen, {_CSV_TEXT} AS job_summary, to_json([source, lang]) AS job_skills FROM documents"""


def _csv_rows(spark, sf):
    """Documents as rows of a posting list: quotes, commas and line breaks inside fields, a list as skills."""
    text = F.nullif(F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(""))
    return table(spark, sf, "documents").select(
        F.md5("text").alias("job_link"),
        F.concat(F.col("source"), F.lit(', "'), F.col("lang"), F.lit('"')).alias("job_title"),
        F.col("source").alias("company"),
        F.col("lang").alias("job_location"),
        F.col("doc_id").cast("string").alias("first_seen"),
        F.lit("").alias("job_level"),
        F.lit(None).cast("string").alias("job_type"),
        text.alias("job_summary"),
        F.array("source", "lang").alias("job_skills"),
    )


@query(
    "s1_s6_csv_round_trip",
    f"SELECT row_number() OVER (ORDER BY CAST(first_seen AS BIGINT)) AS place, * FROM ({_SQL_CSV})",
)
def s1_s6(spark, sf):
    """Several CSV files of cleaned postings, sorted across files, read again in their order."""
    path = _folder(spark, "cleaned")
    write_csv(_csv_rows(spark, sf).orderBy(F.col("first_seen").cast("long")), path)
    rows = P.read_posting_csv_in_order(spark, path)
    ranked = with_rank(rows.select("arrival_seq", "first_seen"), [F.col("arrival_seq")], rank="place")
    return rows.drop("job_level", "job_type", "arrival_seq").join(ranked.select("first_seen", "place"), "first_seen")


@query(
    "s7_filtered_sink",
    f"SELECT company, job_location, job_summary FROM ({_SQL_CSV}) WHERE regexp_matches(lower(job_summary), 'pour|with ')",
)
def s7(spark, sf):
    path = _folder(spark, "filtered")
    write_csv(_csv_rows(spark, sf).where(F.lower("job_summary").rlike("pour|with ")), path)
    return P.read_posting_csv(spark, path).select("company", "job_location", "job_summary")


@query(
    "s8_landed_sink",
    f"WITH {_SQL_PAGES} SELECT source AS company, lang AS job_location, md5(text) AS job_link, 'United States' AS search_country FROM flat WHERE lang IN ('en', 'fr')",
)
def s8(spark, sf):
    """The reduced landing as CSV."""
    path = _folder(spark, "landed")
    write_csv(P.accepted(P.flatten_reduced(_whole(spark, sf))), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("company", "job_location", "job_link", "search_country")


@query("s5_resumes", f"SELECT item_id, {sql_norm('text')} AS resume_text FROM benchmark WHERE {sql_norm('text')} <> ''")
def s5(spark, sf):
    """The profiles' resumes, each a text file in a folder of its number."""
    path = _folder(spark, "resumes")
    items = table(spark, sf, "benchmark").where(T.normalize(F.col("text")) != "").select("text", "item_id")
    items.repartitionByRange("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    found = P.read_resumes(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "resume_text")
