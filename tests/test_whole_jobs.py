"""Registered queries do the whole job: all rows, all resamples, all trees and folds."""

import hashlib
import random
from types import SimpleNamespace

import pytest

from hypolake import more_queries as M


def slow_auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    if not pos or not neg:
        return None
    count = lambda ps: {p: ps.count(p) for p in set(ps)}
    a, b = count(pos), count(neg)
    return sum(n * m * (1.0 if p > q else 0.5 if p == q else 0.0) for p, n in a.items() for q, m in b.items()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def predictions(spark):
    """Two runs of 660 rows, of which the last 60 are ranked the wrong way round, and one without positives."""
    rng = random.Random(7)
    rows = []
    for run in (1, 2):
        for i in range(660):
            y = rng.random() < 0.3
            rows.append((run, i, rng.randint(0, 8) / 16 + (0.4 if y == (i < 600) else 0.0), y))
    rows += [(3, i, 0.5, False) for i in range(5)]
    return rows, SimpleNamespace(prediction=spark.createDataFrame(rows, "run_id long, row_id long, p double, y boolean").persist())


@pytest.fixture(scope="module")
def expected(predictions):
    out = {}
    for run in (1, 2):
        rows = [(p, y) for r, _, p, y in predictions[0] if r == run]
        n = len(rows)
        draws = [[rows[int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)] for rep in range(200)]
        v = sorted(slow_auc(d) for d in draws)
        out[run] = (slow_auc(rows), v[5], v[195])
    return out


def test_bootstrap_takes_all_rows_and_200_resamples(predictions, expected):
    got = {r["run_id"]: r for r in M.QUERIES["m7_bootstrap_all_rows"][0](predictions[1]).collect()}
    for run, want in expected.items():
        assert [got[run][c] for c in ("auc", "auc_lo", "auc_hi")] == pytest.approx(want, abs=1e-7)
    assert (got[3]["auc"], got[3]["auc_lo"], got[3]["auc_hi"]) == (None, None, None)


def test_leaderboard_has_the_bootstrap_interval(predictions, expected):
    got = {r["run_id"]: r for r in M.QUERIES["v18_leaderboard_bootstrap"][0](predictions[1]).collect()}
    for run, (auc, lo, hi) in expected.items():
        assert got[run]["auc"] == pytest.approx(auc, abs=6e-4)
        low, high = got[run]["auc_ci"].strip("[]").split(", ")
        assert (float(low), float(high)) == (pytest.approx(lo, abs=6e-4), pytest.approx(hi, abs=6e-4))
    assert got[3]["auc_ci"] is None


def test_odds_ratios_take_500_draws(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", 12, 8, 9, 31)], "cohort string, dimension string, high_approved long, high_failed long, low_approved long, low_failed long")
    monkeypatch.setattr(M.V, "effect_sizes", lambda e: cells)
    got = M.QUERIES["m8_odds_ratio_intervals"][0](None).first()
    values = []
    for rep in range(500):
        c = [0] * 4
        for i in range(60):
            d = int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) % 60
            c[0 if d < 12 else 1 if d < 20 else 2 if d < 29 else 3] += 1
        a, b, e, f = (x + 0.5 for x in c) if 0 in c else c
        values.append(a * f / (b * e))
    values.sort()
    assert [got["odds_ratio_lo"], got["odds_ratio_hi"]] == pytest.approx([values[12], values[487]], abs=1e-7)


@pytest.mark.parametrize(("name", "trees"), [("l3_logistic_group_folds", None), ("l5_forest_stratified", (200, 8))])
def test_models_take_five_folds_and_all_trees(spark, monkeypatch, name, trees):
    rows = spark.range(60).selectExpr("id AS target_id", "id AS indication_id", "CAST(id % 3 = 0 AS DOUBLE) AS label")
    seen = []
    monkeypatch.setattr(M.V, "strict_cohort", lambda e, n: rows)
    monkeypatch.setattr(M.ml, "labelled", lambda d: d)
    monkeypatch.setattr(M.ml, "out_of_fold", lambda d, maker, names, k=5: seen.append((maker, k, d.select("fold").distinct().count())) or d.selectExpr("label", "0.5D AS p"))
    M.QUERIES[name][0](None)
    maker, k, folds = seen[0]
    assert (k, folds) == (5, 5)
    if trees:
        held = dict(zip(maker.__code__.co_freevars, (c.cell_contents for c in maker.__closure__)))
        assert (held["trees"], held["depth"]) == trees
