"""Landed API pages, posting CSVs and resumes as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from roleweave.functions import text as T
from roleweave.operators.skills import SkillExtractor
from roleweave.schema import API_PAGE, POSTING_CSV, nan_to_null

#: Digits of numbers in an order key: as many as the longest number has.
ORDER_DIGITS = 19
# Fixed value: postings per page of the landed feed.
PAGE_ROWS = 50


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON document per file; the page number comes from the file name.

    Company, location and category are read as raw text, so a value that is not an object is
    seen as such instead of failing the file.
    """
    options = {"multiLine": True, "columnNameOfCorruptRecord": "corrupt"}
    pages = spark.read.schema(API_PAGE).options(**options).json(path)
    name = F.input_file_name()
    number = F.regexp_extract(name, r"(\d+)\.json$", 1).try_cast("int")
    landed = pages.withColumn("page", F.coalesce("page", number))
    return landed.withColumn("search", F.regexp_extract(name, r"([^/]*)/[^/]*$", 1))


def parse_pages(json: Column) -> Column:
    """A landed page given as text; one that cannot be parsed keeps its text in ``corrupt``."""
    return F.from_json(json, API_PAGE, {"columnNameOfCorruptRecord": "corrupt"})


def usable_pages(pages: DataFrame, search: str | None = None, max_pages: int | None = None) -> DataFrame:
    """Pages a search would read: before the first empty page, and up to a limit if one is given.

    A page that failed is absent or corrupt; it is left out and does not end the search.  ``search``
    names the column that tells searches apart.
    """
    capped = pages.where(F.col("corrupt").isNull()) if "corrupt" in pages.columns else pages
    if max_pages is not None:
        capped = capped.where(F.col("page") <= max_pages)
    empty = capped.where(F.coalesce(F.size("results"), F.lit(0)) == 0)
    if search is None:
        stop = empty.agg(F.min("page")).scalar()
        return capped.where(F.coalesce(F.col("page") < stop, F.lit(True)))
    stops = empty.groupBy(search).agg(F.min("page").alias("_stop"))
    return (
        capped.join(stops, search, "left")
        .where(F.coalesce(F.col("page") < F.col("_stop"), F.lit(True)))
        .drop("_stop")
    )


def _nested(raw: Column, field: str) -> Column:
    """Field of a nested object given as raw JSON; empty unless the value is an object."""
    is_object = F.ltrim(raw).startswith("{")
    return F.when(is_object, F.get_json_object(raw, f"$.{field}"))


def _order_part(pages: DataFrame, name: str) -> Column:
    """A column as a part of the order key: whole numbers padded, texts whole, with the separator escaped."""
    value = F.col(name).cast("string")
    if isinstance(pages.schema[name].dataType, IntegralType):
        return F.lpad(F.coalesce(value, F.lit("")), ORDER_DIGITS, "0")
    escaped = F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.coalesce(escaped, F.lit("%null"))


def flatten_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per posting, every text normalized.

    ``arrival_seq`` orders by the ``keep`` columns (the search or file), page and place in the page;
    it is unique if they tell all pages apart, and serves as ``posting_id`` too.  Names are never cut,
    so searches that begin alike stay apart.
    """
    rows = pages.select(*keep, "page", F.posexplode("results").alias("pos", "r"))
    arrival = F.concat_ws("/", *[_order_part(rows, c) for c in (*keep, "page", "pos")])
    return rows.select(
        *keep,
        arrival.alias("arrival_seq"),
        arrival.alias("posting_id"),
        T.normalize(F.col("r.title")).alias("job_title"),
        T.normalize(_nested(F.col("r.company"), "display_name")).alias("company"),
        T.normalize(_nested(F.col("r.location"), "display_name")).alias("job_location"),
        T.normalize(F.col("r.description")).alias("job_description"),
        T.normalize(F.col("r.redirect_url")).alias("job_link"),
        T.normalize(_nested(F.col("r.category"), "label")).alias("category"),
        T.normalize(F.col("r.contract_type")).alias("contract_type"),
        T.normalize(F.col("r.contract_time")).alias("contract_time"),
        F.lit("United States").alias("search_country"),
        nan_to_null(F.col("r.salary_min")).alias("salary_min"),
        nan_to_null(F.col("r.salary_max")).alias("salary_max"),
        F.col("page").alias("source_page"),
    )


def with_skills(postings: DataFrame, extractor: SkillExtractor) -> DataFrame:
    """Add the extracted skills as a list and as text, and the joined posting text."""
    listed = postings.withColumn(
        "job_skills_list", extractor.posting_skills(F.col("job_title"), F.col("job_description"))
    ).withColumn("job_skills", T.join_list(F.col("job_skills_list")))
    return listed.withColumn(
        "job_text",
        T.posting_text(*[F.col(c) for c in ("job_title", "job_description", "job_skills", "company", "job_location")]),
    )


REDUCED_COLUMNS = (
    "job_title", "company", "job_location", "job_description", "job_link", "job_skills", "search_country", "job_level", "job_type",
)


def flatten_reduced(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The reduced landing of every posting, with ``reason``: what it lacks, null if it is whole.

    Nine columns: blank skills, level and type, names of company and place required.  The ``keep``
    columns, page and place in the page come first.  ``accepted`` and ``rejected`` part the result;
    both read the same pass.
    """
    rows = pages.select(*keep, "page", F.posexplode("results").alias("pos", "r"))
    company, place = _nested(F.col("r.company"), "display_name"), _nested(F.col("r.location"), "display_name")
    reason = F.when(F.col("r").isNull(), "posting is null").when(company.isNull(), "company without display_name").when(
        place.isNull(), "location without display_name"
    )
    return rows.select(
        *keep,
        "page",
        "pos",
        F.col("r.title").alias("job_title"),
        company.alias("company"),
        place.alias("job_location"),
        F.col("r.description").alias("job_description"),
        F.col("r.redirect_url").alias("job_link"),
        F.lit("").alias("job_skills"),
        F.lit("United States").alias("search_country"),
        F.lit("").alias("job_level"),
        F.lit("").alias("job_type"),
        reason.alias("reason"),
    )


def accepted(reduced: DataFrame) -> DataFrame:
    """The nine columns of the postings that have what is required."""
    return reduced.where("reason IS NULL").select(*REDUCED_COLUMNS)


def rejected(reduced: DataFrame) -> DataFrame:
    """The other postings, whole, each with its ``reason``."""
    return reduced.where("reason IS NOT NULL")


def read_posting_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(POSTING_CSV)
        .option("header", True).option("multiLine", True).option("escape", '"')
        .csv(path)
    )


def read_posting_csv_in_order(spark: SparkSession, path: str) -> DataFrame:
    """The posting CSVs of a folder with ``arrival_seq``: file name, then row.

    A file with line breaks inside quotes is read by one task from its start, so the row numbers of
    a task grow along the file.  The key is unique and orders the rows; its numbers have gaps.
    """
    rows = read_posting_csv(spark, path).select("*", F.col("_metadata.file_path").alias("_file"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    key = F.concat_ws("/", _order_part(rows, "_file"), _order_part(rows, "_row"))
    return rows.withColumn("arrival_seq", key).drop("_file", "_row")


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text resumes: bytes that are not UTF-8 are dropped, blanks collapsed."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return raw.select("path", T.normalize(decoded).alias("resume_text"))
