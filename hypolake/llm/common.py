"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from hypolake.operators.lineage import cut, ensure_checkpoint_dir

__all__ = ["SPACE_CLASS", "cut", "passing", "small_batches", "table", "written", "written_in_turn"]

#: Words of the contracts: runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that go to Python at once, at most.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_ROWS rows: documents are large, and a task holds a batch several times over."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint where rows are many. It is deleted when the application ends."""
    return written_in_turn([df])


def _folder(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there is deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    fs, place = _store(spark, path)
    fs.deleteOnExit(place)
    return path


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: Spark's own setting by which a query's shuffles are deleted as it ends, and not when the driver next collects garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, before)


def written_in_turn(parts: Iterable[DataFrame], path: str | None = None) -> DataFrame:
    """One Parquet table, in the shared folder until the application ends, of parts (of one schema, at least one) that are made and written one after another. What they shuffled goes once they are written."""
    spark = schema = None
    for part in parts:
        if schema is None:
            spark, schema = part.sparkSession, part.schema
            path = path or _folder(spark)
        with _shuffles_end(spark):
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """written(), for tables that nothing reads after the block: they are deleted as it ends."""
    made = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(_folder(spark))
        return written_in_turn([df], made[-1])

    try:
        yield keep
    finally:
        for path in made:
            fs, place = _store(spark, path)
            fs.delete(place, True)
