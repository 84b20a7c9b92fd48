"""Ingest in one pass, order of rows over files, and tables that readers never miss."""

import threading

import pytest
from pyspark.sql import functions as F

from hypolake.plans import scorers
from hypolake.sources import readers, sinks


def test_bad_lines_are_counted_and_kept_aside(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": 2', '{"a": "no number"}', "", '{"b": "only"}', "[", '{"a": 3, "b": "y", "c": 1}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    df = readers.json_lines_with_bad(spark, str(tmp_path / "in.jsonl"), "a long, b string")
    target, log = str(tmp_path / "t"), str(tmp_path / "log")
    counts = sinks.ingest(df, target, log, "in.jsonl", "t")
    table = spark.read.parquet(target)
    assert counts == {"read": table.count(), "skipped": 3, "inserted": 3}
    assert {r[readers.CORRUPT] for r in table.where("is_bad = 1").collect()} == {lines[1], lines[2], lines[5]}
    assert {(r["a"], r["b"]) for r in table.where("is_bad = 0").collect()} == {(1, "x"), (None, "only"), (3, "y")}
    row = spark.read.parquet(log).first()
    assert (row["rows_read"], row["rows_inserted"], row["rows_skipped"], row["status"]) == (6, 3, 3, "ok")
    sinks.ingest(df, target, log, "in.jsonl", "t")
    assert spark.read.parquet(target).count() == 12 and spark.read.parquet(log).count() == 2


def test_last_score_by_files_and_lines_whatever_the_partitions(spark, tmp_path):
    for f in range(6):
        body = "".join(f"{k % 5},{k % 2},{(f * 100 + k) / 1000}\n" for k in range(40))
        (tmp_path / f"s{f}.csv").write_text("target_id,indication_id,predicted_p_approval\n" + body)
    want = {(k % 5, k % 2): (500 + k) / 1000 for k in range(40)}
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    try:
        for cost in ("4194304", "0", "134217728"):  # files together in a task, or one each
            spark.conf.set(key, cost)
            got = readers.last_scores(readers.external_scores(spark, str(tmp_path))).collect()
            assert {(r["target_id"], r["indication_id"]): r["p"] for r in got} == want
    finally:
        spark.conf.set(key, before)
    cohort = spark.createDataFrame([(1, 1, True), (9, 9, False)], "target_id long, indication_id long, any_approved boolean")
    scored = scorers.external(cohort, readers.external_scores(spark, str(tmp_path)))
    assert {r["target_id"]: r["p"] for r in scored.collect()}[1] == pytest.approx(want[1, 1])


def test_a_reader_never_misses_the_table(spark, tmp_path):
    path, seen, failed, stop = str(tmp_path / "t"), [], [], threading.Event()
    sinks.commit_version(spark.range(100).withColumn("v", F.lit(0)), path)

    def read():
        while not stop.is_set():
            try:
                seen.append(tuple(sinks.current(spark, path).agg(F.count("*"), F.min("v"), F.max("v")).first()))
            except Exception as error:  # the test fails below
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 7):
        sinks.commit_version(spark.range(100).withColumn("v", F.lit(v)), path, keep=3)
    stop.set()
    reader.join()
    assert not failed and all(n == 100 and low == high for n, low, high in seen)
    assert sinks.current(spark, path).first()["v"] == 6
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 3


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    sinks.commit_version(spark.range(5), path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.commit_version(spark.range(9), path)
    assert sinks.current(spark, path).count() == 5
    sinks.commit_version(spark.range(7), path, keep=1)
    assert sinks.current(spark, path).count() == 7 and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1
