"""The pipeline's stages against brute force on the smallest tables."""

import hashlib

import corpus_pipeline as P
import __spark_entry__ as entry

from hypolake.llm import bpe, toxicity
from hypolake.llm.queries import vocabulary_path


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    step = P.STAGES[0][1](spark, docs, data).persist()
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet")).ready()
    assert {r["doc_id"] for r in step.collect()} == {i for i, r in before.items() if model.score(r["text"]) < 0.5}
    from test_simhash import slow_components, slow_fingerprint, slow_sets

    kept = {r["doc_id"]: r["text"] for r in step.collect()}
    dedup = P.STAGES[1][1](spark, step, data).persist()
    want = {c for _, _, c in slow_components([(i, slow_fingerprint(t)) for i, t in kept.items()], sets=[slow_sets(t) for t in kept.values()])}
    assert sorted(r["doc_id"] for r in dedup.collect()) == sorted(want)
    clean = P.STAGES[2][1](spark, dedup, data).persist()
    assert clean.count() == dedup.count()
    assert clean.where("""text rlike '(?i)token = "[0-9a-f]{40}"'""").count() == 0
    assert clean.where("n_chars != length(text)").count() == 0
    mixed = P.STAGES[3][1](spark, clean, data).persist()
    assert all(x.columns == names for x in (step, dedup, clean, mixed))
    last = P.STAGES[4][1](spark, mixed, data).collect()
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(bpe.pack(r["ids"])).hexdigest() for r in last)
    got = sorted(tuple(r)[:4] for r in last)
    want = []
    for r in mixed.collect():
        ids = bpe.encode(vocabulary_path(), r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(bpe.pack(ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert got == sorted(want)


def test_registered(spark, data):
    assert len(P.STAGES) == 5 and "pipeline" in entry.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in entry.queries())] == list(range(1, 11))
    assert P.run(spark, data).count() > 50


def test_sql_of_the_operators(spark, data):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    for name in ("op8_exact_top_k", "op9_substring_dedup", "op10_chat_formatting"):
        df = entry.queries()[name](spark, data)
        cur = c.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall())), name


def test_hard_rows_pass_all_stages(spark, data):
    import random

    from helpers import documents, hard_rows

    for rows in (hard_rows(random.Random(40)), []):
        docs = documents(spark, rows)
        names = docs.columns
        for name, stage in P.STAGES:
            docs = stage(spark, docs, data)
            if name != P.STAGES[-1][0]:
                assert docs.columns == names
                docs = docs.persist()
        out = docs.collect()
        assert (len(out) > 0) == bool(rows)
        assert {r["doc_id"] for r in out} <= {i for i, _ in rows}
