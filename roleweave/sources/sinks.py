"""Writers for cleaned, filtered and ranked postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from roleweave.schema import EXPORT_COLUMNS


def csv_ready(df: DataFrame) -> DataFrame:
    """Lists and structs as JSON text, which CSV can hold."""
    nested = (t.ArrayType, t.MapType, t.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        csv_ready(df).write.mode(mode)
        .option("header", True).option("escape", '"').option("quoteAll", False)
        .csv(path)
    )


def export_columns(ranked: DataFrame) -> DataFrame:
    """The export columns that the table has, in export order."""
    return ranked.select(*[c for c in EXPORT_COLUMNS if c in ranked.columns])


def write_ranked(ranked: DataFrame, path: str, order: list) -> None:
    """All ranked rows in order: sorted across files, file name order is rank order."""
    write_csv(export_columns(ranked.orderBy(*order)), path)
