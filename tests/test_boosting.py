"""Boosting on one machine, row by row, against the aggregations; and the signs of constrained features."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypolake.plans import boosting, ml

NAMES = ["a", "b", "c", "d"]
SMALL = boosting.Settings(rounds=6, depth=3, step=0.3, bins=8, least_rows=10, l1=0.5, l2=1.0, columns=0.75, signs={"a": 1, "b": -1})


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 2] = rng.integers(0, 3, n)
    # against the sign of b in part of the space, so that splits have to be refused
    z = 1.5 * x[:, 0] + np.where(x[:, 2] == 1, 1.0, -1.0) * x[:, 1] + 0.3 * x[:, 3]
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    x[rng.random((n, 4)) < 0.1] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, fold int").repartition(5)


def one_machine(x, y, cuts, s, model=0):
    """The same trees by going through rows, features and cuts one at a time."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    soft = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    margin, trees = np.zeros(n), []
    for number in range(s.rounds):
        used = np.sort(np.random.default_rng((s.seed, number, model)).choice(len(NAMES), max(1, round(s.columns * len(NAMES))), replace=False))
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)

        def leaf(rows, low, high):
            return min(high, max(low, -soft(g[rows].sum()) / (h[rows].sum() + s.l2)))

        def loss(rows, w):
            return g[rows].sum() * w + (h[rows].sum() + s.l2) * w * w / 2 + s.l1 * abs(w)

        def build(rows, low, high, depth):
            best = None
            for f in used if depth < s.depth else []:
                for cut_ in cuts[f]:
                    for unknown_left in (True, False):
                        v = x[rows, f]
                        left = np.where(np.isnan(v), unknown_left, v <= cut_)
                        lr, rr = rows[left], rows[~left]
                        if min(len(lr), len(rr)) < s.least_rows:
                            continue
                        wl, wr = leaf(lr, low, high), leaf(rr, low, high)
                        if s.signs.get(NAMES[f], 0) * (wr - wl) < 0:
                            continue
                        gain = loss(rows, leaf(rows, low, high)) - loss(lr, wl) - loss(rr, wr)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 * max(1.0, gain)):
                            best = (gain, f, cut_, unknown_left, lr, rr, wl, wr)
            if best is None:
                return leaf(rows, low, high)
            _, f, cut_, unknown_left, lr, rr, wl, wr = best
            middle, sign = (wl + wr) / 2, s.signs.get(NAMES[f], 0)
            bl = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
            br = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
            return f, cut_, unknown_left, build(lr, *bl, depth + 1), build(rr, *br, depth + 1)

        def value(tree, row):
            while isinstance(tree, tuple):
                f, cut_, unknown_left, left, right = tree
                tree = left if (unknown_left if np.isnan(row[f]) else row[f] <= cut_) else right
            return tree

        trees.append(build(np.arange(n), -np.inf, np.inf, 0))
        margin += [s.step * value(trees[-1], r) for r in x]
    return 1 / (1 + np.exp(-margin))


def test_against_one_machine(spark):
    x, y = made(500)
    df = frame(spark, x, y)
    cuts = boosting.quantile_cuts(df, NAMES, SMALL.bins)
    got = {r["id"]: r["p"] for r in boosting.boosted(SMALL)(df, NAMES)(df).collect()}
    want = one_machine(x, y, cuts, SMALL)
    assert [got[i] for i in range(500)] == pytest.approx(want.tolist(), abs=1e-9)


def test_folds_side_by_side_are_those_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)  # margins are written down on the way
    x, y = made(400, 2)
    df = frame(spark, x, y)
    cuts = boosting.quantile_cuts(df, NAMES, SMALL.bins)
    got = {r["id"]: r["p"] for r in boosting.out_of_fold(df, NAMES, 3, SMALL).collect()}
    fold = np.arange(400) % 3
    for k in range(3):
        # the model of the other folds, applied to this one: its rows are put behind with weight nothing by training on the others alone
        one = boosting.fit(df.where(F.col("fold") != k).unionByName(df.where(F.col("fold") == k)), NAMES, F.when(F.col("fold") != k, 1 << k).otherwise(0), 3, SMALL)[k]
        assert one.cuts == cuts
        want = one.scores(x[fold == k])
        assert [got[i] for i in np.flatnonzero(fold == k)] == pytest.approx(want.tolist(), abs=1e-9)


def test_scores_follow_the_signs(spark):
    x, y = made(600, 3)
    df = frame(spark, x, y)
    model = boosting.fit(df, NAMES, F.lit(1), 1, dataclasses.replace(SMALL, rounds=12))[0]
    free = boosting.fit(df, NAMES, F.lit(1), 1, dataclasses.replace(SMALL, rounds=12, signs={}))[0]
    grid = np.linspace(-3, 3, 61)

    def steps(m, f):
        out = []
        for base in x[:80]:
            rows = np.tile(base, (len(grid), 1))
            rows[:, f] = grid
            out.append(np.diff(m.margins(m.bins(rows))))
        return np.array(out)

    assert (steps(model, 0) >= 0).all() and (steps(model, 1) <= 0).all() and steps(model, 0).max() > 0
    assert (steps(free, 1) > 0).any()  # without the sign it would rise somewhere
    assert len(model.trees) == 12 and (model.scores(x)[y == 1].mean() > model.scores(x)[y == 0].mean() + 0.2)


def test_isotonic_variant_is_calibrated_and_held_out(spark):
    x, y = made(600, 4)
    df = frame(spark, x, y).withColumn("inner", (F.col("id") / 3).cast("int") % 2)
    out = boosting.calibrated_out_of_fold(df, NAMES, 3, 2, dataclasses.replace(SMALL, rounds=4)).select("id", "label", "p").collect()
    assert sorted(r["id"] for r in out) == list(range(600)) and all(0 <= r["p"] <= 1 for r in out)
    assert abs(np.mean([r["p"] for r in out]) - y.mean()) < 0.08
    p = {r["id"]: r["p"] for r in out}
    assert np.mean([p[i] for i in range(600) if y[i]]) > np.mean([p[i] for i in range(600) if not y[i]]) + 0.15


def test_defined_cases(spark):
    x, y = made(60, 5)
    df = frame(spark, x, y)
    for rows in (df.where("label = 1"), df.limit(0), df.withColumn("label", F.lit(None).cast("double"))):
        assert {r["p"] for r in boosting.boosted(SMALL)(rows, NAMES)(df).collect()} == {0.5}
    empty = df.withColumn("a", F.lit(None).cast("double"))
    assert empty.count() == boosting.boosted(SMALL)(empty, NAMES)(empty).where("p between 0 and 1").count()
    with pytest.raises(ValueError):
        boosting.fit(df, NAMES, F.lit(1), 63)


def test_trees_of_spark_ml_tell_the_classes_apart(spark):
    x, y = made(300, 6)
    df = frame(spark, x, y)
    p = {r["id"]: r["p"] for r in ml.boosted(rounds=3, depth=3)(df, NAMES)(df).collect()}
    assert len(p) == 300 and np.mean([p[i] for i in range(300) if y[i]]) > np.mean([p[i] for i in range(300) if not y[i]]) + 0.1
