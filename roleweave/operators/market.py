"""Market aggregates over ranked or filtered postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators.rank import top_k

SKILL_GAP_ROWS, SKILL_GAP_TOP = 25, 10


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value, nulls dropped; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else top_k(counts, [F.col("n").desc(), F.col(column).asc()], top)


def skill_gap(
    results: DataFrame, order: list[Column], rows: int = SKILL_GAP_ROWS, top: int = SKILL_GAP_TOP
) -> DataFrame:
    """Skills most often missing in the first rows of the chosen order."""
    first = top_k(results, order, rows)
    return value_counts(first.select(F.explode("missing_skills").alias("skill")), "skill", top)


def salary_means(df: DataFrame, low: str = "salary_min", high: str = "salary_max") -> DataFrame:
    """Means of the two salary bounds, each over its own valid values; null if there are none."""
    return df.na.drop(how="all", subset=[low, high]).agg(
        F.avg(T.parse_number(F.col(low))).alias("avg_min"),
        F.avg(T.parse_number(F.col(high))).alias("avg_max"),
    )


def top_score(df: DataFrame, column: str = "final_score") -> DataFrame:
    return df.agg(F.max(column).alias("top_score"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, type and nulls of each column, from one pass."""
    columns = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(t).alias("type"),
                F.col("_rows").alias("rows"),
                F.col(f"_n{i}").alias("nulls"),
            )
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.explode(lines).alias("line")).select("line.*")


def funnel(flagged: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """How many rows pass each step, in one pass over row flags."""
    return flagged.agg(*[F.count_if(c).alias(name) for name, c in steps.items()])
