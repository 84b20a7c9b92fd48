"""Recalibration, reciprocal ranks, coefficients, group folds and alias tables against one machine."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypolake.functions import sponsors
from hypolake.plans import metrics, ml


def predictions(spark, rows):
    return spark.createDataFrame(rows, "g string, p double, y boolean")


def newton(p, y):
    """Two-parameter logistic regression on single rows."""
    x = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    x = np.column_stack([np.ones(len(x)), x])
    w = np.array([0.0, 1.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    return w


def test_slope_and_reciprocal_rank(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, slope in (("a", 0.5), ("b", 2.0), (None, 1.0)):
        p = np.round(rng.random(400), 2)
        z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        y = rng.random(400) < 1 / (1 + np.exp(-(slope * z - 0.3)))
        rows += [(g, float(v), bool(t)) for v, t in zip(p, y)]
        want[g] = (newton(p, y), np.mean([1 / (1 + (p > v).sum()) for v, t in zip(p, y) if t]))
    rows += [("one class", 0.3, True), ("one class", 0.6, True), ("one score", 0.5, True), ("one score", 0.5, False), ("a", None, True), ("a", 0.5, None)]
    rows += [("parted", v, v > 0.5) for v in (0.1, 0.2, 0.8, 0.9)]
    df = predictions(spark, rows)
    slope = {r["g"]: (r["calibration_intercept"], r["calibration_slope"]) for r in metrics.calibration_slope(df, ["g"]).collect()}
    mrr = {r["g"]: r["mrr"] for r in metrics.mrr(df, ["g"]).collect()}
    for g, (w, m) in want.items():
        assert slope[g] == pytest.approx(w.tolist(), abs=1e-6) and mrr[g] == pytest.approx(m, abs=1e-9)
    assert [slope[g] for g in ("one class", "one score", "parted")] == [(None, None)] * 3
    assert mrr["one class"] == pytest.approx(0.75) and mrr["one score"] == 1.0
    assert metrics.mrr(predictions(spark, [("x", 0.5, False)]), ["g"]).first()["mrr"] is None
    whole = metrics.calibration_slope(df.where("g = 'b'")).first()
    assert whole["calibration_slope"] == pytest.approx(want["b"][0][1], abs=1e-6)
    assert metrics.calibration_slope(df.limit(0), ["g"]).count() == 0


def test_group_folds_are_balanced_whatever_the_number_of_groups(spark):
    few = [(g, i) for g, n in enumerate((50, 30, 30, 20, 5, 5, 1)) for i in range(n)] + [(None, i) for i in range(7)]
    got = ml.group_folds(spark.createDataFrame(few, "target_id long, v int"), "target_id", 3)
    by_group = got.groupBy("target_id").agg(F.countDistinct("fold").alias("n")).collect()
    assert got.count() == len(few) and {r["n"] for r in by_group} == {1} and len(by_group) == 8
    many = spark.range(1_000_000).select((F.pow(F.rand(3), 3) * 200_000).cast("long").alias("target_id"))
    many = many.withColumn("target_id", F.when(F.rand(4) < 0.02, -1).otherwise(F.col("target_id"))).cache()
    largest = many.groupBy("target_id").count().agg(F.max("count")).first()[0]
    folds = [r["count"] for r in ml.group_folds(many, "target_id", 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and sum(folds) == 1_000_000 and max(folds) - min(folds) <= largest
    many.unpersist()
    words = ml.group_folds(spark.createDataFrame([("a",), ("b",), ("a",)], "target_id string"), "target_id", 2)
    assert words.where("target_id = 'a'").select("fold").distinct().count() == 1


def test_coefficients_on_the_original_scale(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.2] + [0, 3, 1]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * (x[:, 1] - 3) + 4 * (x[:, 2] - 1) - 1)))).astype(float)
    x[rng.random((300, 3)) < 0.1] = np.nan
    rows = [(*[None if np.isnan(v) else float(v) for v in r], None, float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, empty double, label double")
    got = {r["feature"]: (r["beta"], r["beta_original"]) for r in ml.coefficients(df, ["a", "b", "c", "empty"]).collect()}

    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    deviation = filled.std(axis=0)
    z = np.column_stack([np.ones(300), (filled - filled.mean(axis=0)) / deviation])
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    w, ridge = np.zeros(4), np.diag([0, 1, 1, 1]) / 0.5
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (weight * q * (1 - q))[:, None]).T @ z + ridge, z.T @ (weight * (y - q)) - ridge @ w)
    assert set(got) == {"a", "b", "c"}
    assert [got[k][0] for k in "abc"] == pytest.approx(w[1:].tolist(), abs=1e-4)
    assert [got[k][1] for k in "abc"] == pytest.approx((w[1:] / deviation).tolist(), abs=1e-3)


def test_agreement_and_top_features(spark):
    relative = spark.createDataFrame([("A. GWAS ≥50", 2.0, 100), ("B. SC Tau ≥0.75", 0.5, 200), ("E. Line E lit high (≥2)", 3.0, 99), ("C. DepMap pan-essential", None, 500), ("unmapped", 2.0, 500), ("D. HPO ≥10 phenotypes", 1.0, 100)], "dimension string, relative_success double, n_supported long")
    found = spark.createDataFrame([("gwas_n_sig", 0.5, 1.0), ("sc_tau_specificity", 0.1, 1.0), ("n_hpo_phenotypes", -0.2, 1.0), ("other", 0.5, 1.0)], "feature string, beta double, beta_original double")
    rows = ml.feature_agreement(relative, found)
    assert {r["feature"]: r["agrees"] for r in rows.collect()} == {"gwas_n_sig": True, "sc_tau_specificity": False, "n_hpo_phenotypes": True}
    assert tuple(ml.aligned_share(rows).first()) == (3, 66.7)
    top = [(r["side"], r["rank"], r["feature"]) for r in ml.top_features(found, 2).collect()]
    assert sorted(top) == [("negative", 1, "n_hpo_phenotypes"), ("negative", 2, "sc_tau_specificity"), ("positive", 1, "gwas_n_sig"), ("positive", 2, "other")]
    assert set(ml.DIMENSION_FEATURES.values()) <= set(ml.feature_names())


def test_alias_table_finds_what_a_scan_of_all_aliases_finds(spark):
    rng = random.Random(3)
    words = ["pfi", "pfizer", "merck", "merck kgaa", "bay", "ag", "x", "novo nordisk", "nord", "lilly"]
    aliases = {f"C{i}": tuple(rng.sample(words, rng.randint(0, 3))) for i in range(12)}
    texts = ["Pfizer Inc.", None, "", "  ", "Acme, a subsidiary of Merck KGaA, Darmstadt", "Acme, an affiliate of unknown  parent inc.", "Foo, a Novo Nordisk company", "Nordic Bay AG", "Plain, Ltd.", "X", "Merckx GmbH"]
    texts += [" ".join(rng.choice(words + ["of", "Bio", "Corp."]) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    names = spark.createDataFrame([(t, 1) for t in texts], "sponsor string, raw int")
    got = {r["raw"]: r["canonical"] for r in sponsors.canonical_names(names, "sponsor", sponsors.alias_table(spark, aliases)).collect()}
    want = {r[0]: r[1] for r in names.select("sponsor", sponsors.canonical_sponsor(F.col("sponsor"), aliases)).collect()}
    assert got == want and len(got) == len(set(texts))
    none = sponsors.canonical_names(names, "sponsor", sponsors.alias_table(spark, aliases).limit(0))
    assert none.count() == len(set(texts)) and sponsors.canonical_names(names.limit(0), "sponsor", sponsors.alias_table(spark, aliases)).count() == 0


def test_patterns_of_parents_are_tried_on_marked_names_only(spark):
    text = sponsors.lineage_parent(F.col("low"))._jc.toString()
    assert len(sponsors.MARKS) == len(sponsors.LINEAGE) and all(m in text for m in sponsors.MARKS)
    names = ["genzyme, a sanofi company", "x (subsidiary of roche inc.)", "y affiliate of msd , ltd", "z healthcare company of merck kgaa", "company", "subsidiary of", "plain"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "low string").select(sponsors.lineage_parent(F.col("low"))).collect()]
    assert got == ["sanofi", "roche", "msd", "merck kgaa", None, None, None]
