import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from helpers import documents, hard_rows
from pyspark.sql import functions as F

from hypolake.llm import language

SYLLABLES = {"aa": "ka lo mi ta re".split(), "bb": "zu ñe ßo ti qa".split(), "cc": "да не ли ка зу".split()}


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def labelled(spark, rows):
    langs = spark.createDataFrame([(i, lang) for i, _, lang in rows], "doc_id long, l string")
    return documents(spark, [(i, t) for i, t, _ in rows]).join(langs, "doc_id").withColumn("lang", F.col("l")).drop("l")


def brute_counts(text):
    """n-grams counted one by one, with the hash written out."""
    fold = lambda c: (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " "
    signs = []
    for c in f" {text} ":
        if fold(c) != " " or not signs or signs[-1] != " ":
            signs.append(fold(c))
    out = Counter()
    for order in range(1, 5):
        for at in range(len(signs) - order + 1):
            h = 0
            for k in range(order):
                h = (h * 0x01000193 + ord(signs[at + k]) + k + 1) % 2**32
            h = (h ^ (h >> 15)) * 0x9E3779B1 % 2**32
            out[h >> 15] += 1
    return dict(out)


def test_counts_against_brute_force(monkeypatch):
    rng = random.Random(3)
    for piece in (1_000_000, 7, 16, 1, 2):
        monkeypatch.setattr(language, "PIECE", piece)
        for _ in range(25):
            text = "".join(rng.choice("abcÄß漢é1 ,.\ń🙂İ") for _ in range(rng.randint(1, 60))) + "x"
            buckets, n = language.counts(text)
            assert dict(zip(buckets.tolist(), n.tolist())) == brute_counts(text)
    assert language.counts("12 ,.") is None and language.counts(None) is None and language.counts("́") is None


def test_frequencies_count_every_document(spark):
    rows = corpus(random.Random(4), 80) + [(100, None, "aa"), (101, "1 2", "aa"), (102, "", "aa")]
    n, found = language.document_frequencies(documents(spark, [(i, t) for i, t, _ in rows]).repartition(5))
    want = Counter(b for _, t, _ in rows if t and any(c.isalpha() for c in t) for b in brute_counts(t))
    assert n == 80 and {int(b): int(found[b]) for b in np.flatnonzero(found)} == dict(want)


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        noise = rng.choice(np.arange(10, 2000), 20, replace=False)
        at = np.sort(np.append(noise, i % 3)).astype(np.int32)
        rows.append((at, np.full(21, 1 / math.sqrt(21)), i % 3))
    w, _ = language.follow_the_regularised_leader(rows, 3)
    assert (w[:3].argmax(axis=1) == [0, 1, 2]).all() and (w != 0).mean() < 0.05
    assert np.abs(w[:3].max(axis=1)).min() > np.abs(w[10:]).max()


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3)) * 3
    truth = np.array([rng.choice(3, p=p) for p in language.softmax(logits / 2.5)])
    assert abs(language.temperature(logits, truth) - 2.5) < 0.25
    assert 0.05 < language.temperature(np.eye(3)[[0, 1, 2] * 30] * 4, np.array([0, 1, 2] * 30)) < 5


def test_held_out_accuracy_and_labels_not_read(spark):
    rows = corpus(random.Random(5), 600)
    docs = labelled(spark, rows)
    got = {r["doc_id"]: r for r in language.identify(docs, language.train(docs)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(lang, got[i]["lang_pred"]) for i, _, lang in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    # labels of the held-out fold, sources and ids of texts play no part
    other = docs.withColumn("lang", F.when(language.remainder() == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(other, language.train(other)).collect()} == {i: r["lang_pred"] for i, r in got.items()}


def test_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg("score")).first()
    assert right[0] > 0.99 and abs(right[0] - right[1]) < 0.05


def test_hard_rows(spark):
    docs = labelled(spark, corpus(random.Random(6), 200))
    model = language.train(docs)
    hard = documents(spark, hard_rows(random.Random(7)))
    got = language.identify(hard, model).collect()
    assert len(got) == 12 and all(r["lang_pred"] in SYLLABLES or (r["lang_pred"], r["score"]) == ("und", 0.0) for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert language.identify(documents(spark, []), model).count() == 0
    none = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs.limit(3), none).collect()} == {("und", 0.0)}
    one = language.train(docs.where("lang = 'aa'"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs.limit(5), one).collect()} == {("aa", 1.0)}
    assert language.train(documents(spark, [])).languages == []


def test_bounds_of_the_sample(spark):
    rows = corpus(random.Random(8), 300) + [(1000 + i, "ka lo " * 5000, "aa") for i in range(5)]
    docs = labelled(spark, rows)
    some, languages = language.sample(docs, "doc_id", "text", "lang", 30, 60_000, 2)
    assert len(languages) == 2 and 0 < len(some) <= 60 and max(len(t) for t, _ in some) <= 30_000
