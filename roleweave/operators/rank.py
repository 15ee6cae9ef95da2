"""Sorting, top-k, global ranks and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roleweave.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in the low 33 bits


#: The column that each order of a result list goes by.
SORT_COLUMNS = {
    "Best Match": "final_score",
    "Skills Match": "skill_score",
    "Role Match": "role_score",
    "Job Title (A-Z)": "job_title",
    "Company (A-Z)": "company",
}


def sort_keys(option: str) -> list[Column]:
    """Order of a result list; ties follow arrival."""
    column = F.col(SORT_COLUMNS[option])
    first = column.asc_nulls_last() if option.endswith("(A-Z)") else column.desc_nulls_last()
    return [first, F.col("arrival_seq").asc()]


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows: each task keeps k, one merge."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; each task cuts its groups to k before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def with_rank(df: DataFrame, order: list[Column], group: str | None = None, rank: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row without sorting everything in one task.

    The rows are range-partitioned and sorted; a row's rank is its place in its partition plus
    the sizes of the partitions before it.  Equal sort keys may span partitions, so one score
    shared by a third of the rows is no hot spot: give an order that ends in a unique column.
    The sorted rows are checkpointed, because both passes must see the same split; pass narrow
    rows and join the rest by id.  With ``group`` the rank restarts in each group.
    """
    ensure_checkpoint_dir(df.sparkSession)
    lead = [F.col(group).asc()] if group else []
    placed = (
        df.orderBy(*lead, *order).withColumn("_pos", F.monotonically_increasing_id()).checkpoint()
    ).withColumn("_part", F.shiftright("_pos", _LOCAL_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_pos").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)) + 1
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn(rank, place)
    if group:
        starts = ranked.groupBy(group).agg((F.min(rank) - 1).alias("_start"))
        ranked = ranked.join(starts, group).withColumn(rank, F.col(rank) - F.col("_start")).drop("_start")
    return ranked.drop("_pos", "_part", "_before")


def page_bounds(total: Column, page: int, size: int) -> Column:
    """(page, pages, first, last) of a page; a page past the end becomes the last page."""
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(size)).cast("long"))
    current = F.least(F.lit(page).cast("long"), pages)
    return F.struct(
        current.alias("page"),
        pages.alias("pages"),
        ((current - 1) * size + 1).alias("first"),
        (current * size).alias("last"),
    )


def result_page(ranked: DataFrame, page: int, size: int, rank: str = "rank") -> DataFrame:
    """Rows of one page of a ranked table."""
    bounds = ranked.agg(page_bounds(F.coalesce(F.max(rank), F.lit(0)), page, size).alias("b")).scalar()
    return ranked.where(F.col(rank).between(bounds["first"], bounds["last"]))


def head_items(col: Column, n: int) -> Column:
    """First n items of a list."""
    return F.slice(col, 1, n)
