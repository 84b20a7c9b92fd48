import random

import pytest
from helpers import documents, hard_rows, text
from pyspark.sql import functions as F

from hypolake.llm import mixing


def corpus(spark, rng, n=300):
    rows = [(i, " ".join(w + "###" for w in text(rng, 60).split()) if i % 5 == 0 else text(rng, rng.randint(20, 120)) + (" blorgh zwiffel" if i % 7 == 1 else "")) for i in range(n)]
    labels = [(i, int(i % 5 > 0), int(i % 5 > 0 and i % 7 == 1)) for i in range(0, n, 2)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def totals(df):
    return df.agg(*[F.sum(F.expr(f"rate * n_tokens * p_{d}")).alias(d) for d in mixing.DOMAINS], F.sum("n_tokens").alias("all"), F.min("rate").alias("least")).first()


@pytest.mark.parametrize("weights", [{"clean": 0.9, "low": 0.05, "toxic": 0.05}, {"clean": 0.5, "low": 0.4, "toxic": 0.1}])
def test_totals_meet_the_targets(spark, weights):
    docs, labels = corpus(spark, random.Random(50))
    t = totals(mixing.mixed(docs, labels, weights))
    assert t["least"] >= 0
    for d, w in weights.items():
        assert t[d] == pytest.approx(w * t["all"], rel=0.02)


def test_default_targets_and_copies(spark):
    docs, labels = corpus(spark, random.Random(51))
    out = mixing.mixed(docs, labels).persist()
    assert out.where("abs(p_clean + p_low + p_toxic - 1) > 1e-9").count() == 0
    assert out.where("copies not in (floor(rate), floor(rate) + 1)").count() == 0
    assert out.where("doc_id % 5 = 0").agg(F.avg("rate")).first()[0] < 0.7 < 0.95 < out.where("doc_id % 5 > 0 and doc_id % 7 != 1").agg(F.avg("rate")).first()[0]
    again = mixing.resampled(docs, labels)
    assert again.columns == docs.columns and again.count() == out.agg(F.sum("copies")).first()[0]


def test_small_problem_against_brute_force(spark):
    """Rates of three documents against a fine grid."""
    members = spark.createDataFrame([(1, 100, [0.9, 0.1, 0.0]), (2, 50, [0.2, 0.8, 0.0]), (3, 80, [0.1, 0.1, 0.8])], "id long, tokens int, p array<double>")
    weights = {"clean": 0.7, "low": 0.3, "toxic": 0.0}
    steps, got = mixing.fit_rates(members, weights)
    rows = members.withColumn("r", mixing.rate(steps, F.col("p"))).collect()
    target = [230 * w for w in weights.values()]
    loss = lambda rates: sum((sum(r * m["tokens"] * m["p"][d] for r, m in zip(rates, rows)) - target[d]) ** 2 for d in range(3))
    best = min(loss((a / 20, b / 20, c / 20)) for a in range(50) for b in range(50) for c in range(20))
    assert loss([m["r"] for m in rows]) <= best * 1.05 + 5


def test_hard_rows(spark):
    docs, labels = corpus(spark, random.Random(52), 120)
    both = docs.unionByName(documents(spark, [(1000 + (i or 0), t) for i, t in hard_rows(random.Random(53))]))
    out = mixing.mixed(both, labels)
    assert out.count() == both.count() and out.where("n_tokens is null or rate is null or rate < 0").count() == 0
    assert mixing.mixed(documents(spark, []), labels).count() == 0
    assert {r["rate"] for r in mixing.mixed(docs, labels.limit(0)).select("rate").distinct().collect()} == {1.0}


def test_posteriors_of_documents_without_labels(spark):
    """Labels of documents that are not there take no room in the sample, and domains of unlabelled documents are found."""
    rng = random.Random(54)
    docs, labels = corpus(spark, rng)
    absent = spark.range(10_000, 14_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    both = labels.unionByName(absent)
    assert mixing.classifier(docs, both, "doc_id", "text", 150) is not None
    p = mixing.memberships(docs, both, "doc_id", "text").where("id % 2 = 1").select("id", "p").collect()
    want = lambda i: 1 if i % 5 == 0 else 2 if i % 7 == 1 else 0
    right = sum(max(range(3), key=lambda k: r["p"][k]) == want(r["id"]) for r in p)
    assert len(p) == 150 and right >= 0.9 * len(p)
