"""Resampling: hashes of many draws at once, packed draws, and work that is not one row for each draw."""

import contextlib
import hashlib
import io

import numpy as np
import pytest

from hypolake.functions import draws
from hypolake.plans import metrics


def slow(prefix, first, n):
    return np.array([int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(first, first + n)])


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize(("prefix", "first", "n"), [("42:7:", 0, 10_050), ("42:199:", 99_990, 10_020), ("1:3:", 9_999_990, 60), ("12345:12:", 123_456_789, 30), ("42:0:", 2**32 - 10, 20), ("x", 5, 0)])
def test_numbers_are_those_of_md5(prefix, first, n):
    assert draws.numbers(prefix, first, n).tolist() == slow(prefix, first, n).tolist()


@pytest.mark.parametrize("n", [1, 60, 99_999, 2**31 + 5, 2**32 - 1, 2**33])
def test_rows_are_remainders(n):
    x = draws.numbers("42:5:", 0, 20_000)
    assert (draws.rows(x, n) == x.astype(np.uint64) % np.uint64(n)).all()


def test_odds_ratio_draws_are_counted_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(metrics, "STRETCH", 1000)
    cells = {"a": (900, 700, 800, 600), "b": (5, 9, 4, 8), "c": (1, 2, 3, 4), "d": (0, 2500, 30, 11)}
    got = metrics.odds_ratio_intervals(spark.createDataFrame([(k, *v) for k, v in cells.items()], "d string, high_approved long, high_failed long, low_approved long, low_failed long"), ["d"], reps=40)
    assert "Generate" not in plan(got)
    rows = {r["d"]: r for r in got.collect()}
    for name, sizes in cells.items():
        n = sum(sizes)
        if n < 20:
            assert rows[name]["odds_ratio_lo"] is None
            continue
        values = []
        for rep in range(40):
            a, b, c, d = np.histogram(slow(f"42:{rep}:", 0, n) % n, [0, *np.cumsum(sizes)[:3], n + 0.5])[0] if sizes[0] else (0, *np.histogram(slow(f"42:{rep}:", 0, n) % n, [0, *np.cumsum(sizes[1:])[:2], n + 0.5])[0])
            e = 0.5 if 0 in (a, b, c, d) else 0.0
            values.append((a + e) * (d + e) / ((b + e) * (c + e)))
        values.sort()
        assert [rows[name]["odds_ratio_lo"], rows[name]["odds_ratio_hi"]] == pytest.approx([values[1], values[39]])


def test_bootstrap_of_many_scores_and_blocks(spark):
    n, reps = 70_000, 3
    rng = np.random.default_rng(3)
    p, y = rng.permutation(n) / n, rng.random(n) < 0.4
    frame = spark.createDataFrame([(5, i * 3, float(p[i]), bool(y[i])) for i in range(n)], "run long, id long, p double, y boolean")
    made = metrics.resampled_auc(frame, ["run"], "id", reps)
    assert "md5" not in plan(made)
    got = {r["rep"]: r["auc"] for r in made.collect()}
    for rep in range(reps):
        w = np.bincount(slow(f"42:{rep}:", 0, n) % n, minlength=n)
        order = np.argsort(p)
        pos, neg = (w * y)[order].astype(float), (w * ~y)[order].astype(float)
        assert got[rep] == pytest.approx((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()), abs=1e-12)
