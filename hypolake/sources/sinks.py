"""Sinks: upsert, insert-ignore, append, audit rows, reports, and staged swaps of directories."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hypolake.sources.readers import CORRUPT

POLICIES = ("overwrite", "fill", "keep")


def _matched(old: DataFrame, new: DataFrame, key: Sequence[str]):
    on = None
    for k in key:
        part = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = part if on is None else on & part
    return old.alias("o"), new.alias("n"), on


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], policy: Mapping[str, str] | None = None, default: str = "overwrite") -> DataFrame:
    """Old with new merged in on a key that compares nulls as equal, so a second run changes nothing. Policies of a column: overwrite, fill (the new value unless null), keep (the old value unless null). new must have one row a key."""
    o, n, on = _matched(old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True)), key)
    has_old, has_new = F.coalesce(F.col("o._old"), F.lit(False)), F.coalesce(F.col("n._new"), F.lit(False))
    columns = []
    for c in old.columns:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        rule = (policy or {}).get(c, default)
        if rule not in POLICIES:
            raise ValueError(f"policy {rule} of {c}; known: {POLICIES}")
        if c in key or c not in new.columns:
            value = F.when(has_old, was).otherwise(now)
        elif rule == "overwrite":
            value = F.when(has_new, now).otherwise(was)
        else:
            value = F.coalesce(now, was) if rule == "fill" else F.coalesce(was, now)
        columns.append(value.alias(c))
    return o.join(n, on, "full").select(*columns)


def inserted_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old and those rows of new whose key is not there."""
    n, o, on = new.alias("n"), old.alias("o"), None
    for k in key:
        part = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        on = part if on is None else on & part
    return old.unionByName(n.join(o, on, "left_anti").select("n.*"))


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """S8."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("append").parquet(path)


def log_ingest(spark: SparkSession, path: str, source: str, target: str, read: int | None, inserted: int | None, skipped: int | None = None, updated: int | None = None, status: str = "ok", notes: str | None = None) -> None:
    """One audit row."""
    schema = "source_file string, target_table string, rows_read long, rows_inserted long, rows_skipped long, rows_updated long, status string, notes string"
    append(spark.createDataFrame([(source, target, read, inserted, skipped, updated, status, notes)], schema).withColumn("finished_at", F.current_timestamp()), path)


def ingest(df: DataFrame, path: str, log: str, source: str, target: str, bad: str = CORRUPT) -> dict[str, int]:
    """Df appended at path in one pass, and an audit row of what was read, inserted and skipped.

    Rows with a text in the column ``bad`` are kept aside, as the part is_bad=1 of the table; the counts are taken
    on the way by an observation, so that nothing is read twice. A table is read by where("is_bad = 0"), which prunes
    the other part.
    """
    seen = Observation()
    rows = df.withColumn("is_bad", F.col(bad).isNotNull().cast("int")).observe(seen, F.count("*").alias("read"), F.count(bad).alias("skipped"))
    append(rows, path, "is_bad")
    counts = {"read": seen.get["read"], "skipped": seen.get["skipped"], "inserted": seen.get["read"] - seen.get["skipped"]}
    log_ingest(df.sparkSession, log, source, target, counts["read"], counts["inserted"], counts["skipped"])
    return counts


_COMMITTED = ".committed"


def _folder(spark: SparkSession, path: str):
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return here, here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version visible, by one step: a file that says so by its name."""
    here, fs = _folder(spark, path)
    if not fs.createNewFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(here, version + _COMMITTED)):
        raise RuntimeError(f"{version} of {path} is there already")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions, oldest first: versions are numbered by the time of their writing."""
    here, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(here)] if fs.exists(here) else []
    return sorted(n.removesuffix(_COMMITTED) for n in names if n.endswith(_COMMITTED))


def commit_version(df: DataFrame, path: str, keep: int = 2) -> str:
    """Df as the current version of the table at path, which readers get by ``current``.

    A version is written whole into a folder of its own, and then committed in one step. A reader sees the old
    version or the new one; a writer that is lost before the commit changes nothing. The last ``keep`` versions
    stay, for readers that have begun; older ones, and what lost writers left before them, are deleted.
    """
    spark, version = df.sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    _commit(spark, path, version)
    here, fs = _folder(spark, path)
    of = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(here, name)
    oldest = versions(spark, path)[-max(1, keep) :][0]
    for name in sorted(s.getPath().getName() for s in fs.listStatus(here)):
        if name.startswith("v") and name.removesuffix(_COMMITTED) < oldest:
            fs.delete(of(name.removesuffix(_COMMITTED) + _COMMITTED), False)
            fs.delete(of(name.removesuffix(_COMMITTED)), True)
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that commit_version writes."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no committed version at {path}")
    return spark.read.parquet(f"{path}/{found[-1]}")


def csv_report(df: DataFrame, path: str) -> None:
    """One file with a header, for reports of a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """The table is written beside its place and takes it when it is whole; readers never see a part of it. Between the two renames there is no table: where readers must not miss it, use commit_version."""
    jvm = spark.sparkContext._jvm
    here, staged, past = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.past"))
    df.write.mode("overwrite").parquet(f"{path}.staged")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(past, True)
    if fs.exists(here):
        fs.rename(here, past)
    fs.rename(staged, here)
    fs.delete(past, True)


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """Temporary views in the order given."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
