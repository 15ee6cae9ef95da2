"""Incremental posting ingest with the batch rules of deduplication.

Two key tables remember what earlier batches kept: every link that survived the first pass, even
if the second pass dropped its posting, and every (title, company, location) that survived the
second.  Each batch overwrites its own partition of each table, so a replayed batch changes
nothing.  Equality with the batch result needs files to arrive in arrival order.

A batch does not read the whole history.  ``merge_every`` batches become a run, as many runs a
run of the next level, so batch b needs fewer than ``merge_every`` runs of each level (the digits
of b in that base) and a key is written once per level.  A run is dealt to buckets by key hash,
about ``bucket_keys`` keys each, and a batch reads the buckets of its own keys only.  Buckets below
``FOLDER_KEYS`` keys share a folder, so that small ones do not become a file each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from roleweave.operators.dedup import first_by_link, first_by_triple, posting_keys
from roleweave.session import ensure_checkpoint_dir


#: Keys that a folder of a run has at least on average.
FOLDER_KEYS = 16_384


@dataclass(frozen=True)
class KeySettings:
    """Batches (then runs) per run, keys per bucket on average, and buckets a run has at most (a power of two)."""

    merge_every: int = 16
    bucket_keys: int = 131_072
    max_buckets: int = 4_096


def _absent(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


class KeyTable:
    """Keys of earlier batches below ``path``; ``schema`` has the one key column."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, settings: KeySettings = KeySettings()):
        if settings.merge_every < 2:
            raise ValueError("merge_every has to be at least 2")
        self.spark, self.path, self.schema, self.settings = spark, path, schema, settings
        self.key = schema.fieldNames()[0]

    def add(self, keys: DataFrame, batch_id: int) -> None:
        _write(keys.select(self.key), self.path, batch_id)

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame | None:
        """Those keys of batches before ``batch_id`` that may equal one of ``keys``; None if there is no earlier batch."""
        runs, rest = self._parts(batch_id)
        buckets = self._buckets_of(keys) if runs else set()
        parts = [self._run(level, number, self._ensure(level, number), buckets) for level, number in runs]
        parts += [df for df in [self._batches(rest)] if df is not None]
        return reduce(DataFrame.unionAll, parts) if parts else None

    def _parts(self, batch_id: int) -> tuple[list[tuple[int, int]], range]:
        """Runs, highest level first, and single batches that together hold all batches before ``batch_id``."""
        every, levels = self.settings.merge_every, []
        level, count = 0, batch_id
        while count:
            levels.append((level, range(count // every * every, count)))
            level, count = level + 1, count // every
        rest = levels[0][1] if levels else range(0)
        return [(at, n) for at, numbers in reversed(levels[1:]) for n in numbers], rest

    def _hash(self, of: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(of)).cast("int")

    def _buckets_of(self, keys: DataFrame) -> set[int]:
        """Bucket numbers of the finest division: at most ``max_buckets`` integers."""
        return {r[0] for r in keys.select(self._hash(self.settings.max_buckets).alias("b")).distinct().collect()}

    def _batches(self, numbers: range) -> DataFrame | None:
        if not numbers:
            return None
        try:
            names = ",".join(str(n) for n in numbers)
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={{{names}}}")
        except AnalysisException as e:
            if _absent(e):
                return None
            raise

    def _run(self, level: int, number: int, dealt: tuple[int, int | None], buckets: set[int] | None = None) -> DataFrame:
        of, folders = dealt
        schema = StructType([*self.schema.fields]).add("bucket", IntegerType()).add("folder", IntegerType())
        run = self.spark.read.schema(schema).parquet(self._run_path(level, number))
        wanted = None if buckets is None else {b % of for b in buckets}
        if wanted is not None and len(wanted) < of:
            run = run.where(F.col("bucket").isin(sorted(wanted)))
            if folders is not None:  # runs of before have a folder per bucket
                run = run.where(F.col("folder").isin(sorted({b % folders for b in wanted})))
        return run.select(self.key)

    def _run_path(self, level: int, number: int) -> str:
        return f"{self.path}_runs/level={level}/run={number}"

    def _ensure(self, level: int, number: int) -> tuple[int, int | None]:
        """Buckets and folders of a run, written first if it is not complete.

        The note with their numbers is written last, so a run without one is written
        again.  The content depends on earlier batches only: a replay finds or makes the same.
        """
        note = f"{self.path}_notes/level={level}/run={number}"
        try:
            found = self.spark.read.schema("of int, folders int").parquet(note).first()
        except AnalysisException as e:
            if not _absent(e):
                raise
            found = None
        if found is not None:
            return found["of"], found["folders"]
        every, most = self.settings.merge_every, self.settings.max_buckets
        children = range(number * every, (number + 1) * every)
        if level == 1:
            keys = self._batches(children)
        else:
            keys = reduce(DataFrame.unionAll, [self._run(level - 1, n, self._ensure(level - 1, n)) for n in children])
        if keys is None:
            keys = self.spark.createDataFrame([], self.schema)
        n, of = keys.count(), 1
        while of < n / self.settings.bucket_keys and of < most:
            of *= 2
        folders = of
        while folders > 1 and n < folders * FOLDER_KEYS:
            folders //= 2
        dealt = keys.withColumn("bucket", self._hash(of)).withColumn("folder", F.pmod("bucket", F.lit(folders))).repartition("folder")
        if n == 0:  # a partitioned write of no rows leaves no file to read a schema from
            dealt.drop("folder").write.mode("overwrite").parquet(f"{self._run_path(level, number)}/folder=0")
        else:
            writer = dealt.sortWithinPartitions("folder", "bucket", self.key).write.mode("overwrite")
            writer.partitionBy("folder").parquet(self._run_path(level, number))
        self.spark.createDataFrame([(of, folders)], "of int, folders int").coalesce(1).write.mode("overwrite").parquet(note)
        return of, folders


def dedup_sink(
    target: str, collapse_empty_links: bool = False, settings: KeySettings = KeySettings()
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends the new postings of a batch below ``target``."""

    def unknown(keys: DataFrame, name: str, key: str, batch_id: int) -> tuple[DataFrame, KeyTable]:
        table = KeyTable(keys.sparkSession, f"{target}/{name}", keys.select(key).schema, settings)
        seen = table.known(keys, batch_id)
        return (keys if seen is None else keys.join(seen, key, "left_anti").checkpoint()), table

    def sink(batch: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(batch.sparkSession)
        first = first_by_link(posting_keys(batch, collapse_empty_links)).checkpoint()
        first, links = unknown(first, "links", "link_key", batch_id)
        second, triples = unknown(first_by_triple(first).checkpoint(), "triples", "triple_key", batch_id)
        # Postings last: a batch that fails midway is replayed and overwrites its partitions.
        links.add(first, batch_id)
        triples.add(second, batch_id)
        _write(batch.join(second.select("arrival_seq"), "arrival_seq", "left_semi"), f"{target}/postings", batch_id)

    return sink


def ingest(
    postings: DataFrame,
    target: str,
    checkpoint: str,
    available_now: bool = True,
    collapse_empty_links: bool = False,
    settings: KeySettings = KeySettings(),
) -> StreamingQuery:
    """Run a posting stream into the deduplicated table below ``target``."""
    sink = dedup_sink(target, collapse_empty_links, settings)
    writer = postings.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/postings").drop("batch_id")


def recent_links_only(postings: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Bounded-state variant: drop repeats of a link seen within the watermark delay."""
    return postings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["job_link"])
