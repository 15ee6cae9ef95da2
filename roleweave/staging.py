"""Tables written once for steps that read them several times; they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from roleweave.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it from there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/roleweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
