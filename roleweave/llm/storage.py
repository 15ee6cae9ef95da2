"""Tables written to the folder that all executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where none is named, in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="roleweave-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/roleweave/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it from there, so that later steps neither recompute nor depend on executors.

    Filters on the columns ``by`` read only the files that hold those values.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or passed with ``--py-files``; then this changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
