import numpy as np
import pytest

from hypolake.llm import whitening
from hypolake.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long, deviation long, whitened string, x int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 9, 9, 9, "w", 9, 1) for i, v in rows], SCHEMA)


def brute(rows, k=4):
    """Quantised vectors of sound rows, and their fit list's sums, eigenvalues and vectors, on one machine."""
    sound = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(np.float32(e)) for e in v)]
    x = {j: [int(np.floor(256 * float(np.float32(e)))) for e in v] for j, (_, v) in enumerate(sound)}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return sound, x, n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


def check(got, rows, k=4):
    sound, x, n, sums, values, vectors, trace = brute(rows, k)
    k = min(k, len(sums))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == len(sound) * k
    signs = {}
    for j, (i, _) in enumerate(sound):
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[j], sums))
        for c in range(k):
            want = (np.array(x[j], float) - np.array([s / n for s in sums])) @ vectors[:, c] / np.sqrt(values[c])
            found = by[i, c + 1]
            assert all(r["n"] == n and abs(r["explained"] - values[c] / trace) < 1e-9 and r["identity_error"] < 1e-9 for r in found)
            assert any(r["deviation"] == deviation and abs(abs(r["whitened"]) - abs(want)) < 1e-7 for r in found)
            if abs(want) > 0.1:
                signs.setdefault(c, set()).add(np.sign(found[0]["whitened"]) == np.sign(want)) if len(found) == 1 else None
    assert all(len(s) == 1 for s in signs.values())  # a component has one sign for all rows


def test_query_on_the_tables(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check(op11_embedding_whitening(spark, data).collect(), rows)


@pytest.mark.parametrize(("decay", "columns"), [(0.3, 12), (1.0, 40)])
def test_basis_grows_only_where_residuals_fail(spark, decay, columns):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 40)) * 8 * decay ** np.minimum(np.arange(40), 12))]
    rows += rows[:50]
    docs = frame(spark, rows).repartition(3)
    model = whitening.fit(docs)
    assert model.columns == columns
    check(whitening.component_rows(docs, model).collect(), rows)


def test_hard_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(60, 6)))]
    hard = [(100, None), (101, [1, None, 0, 0, 0, 0]), (102, [float("nan")] * 6), (103, [float("inf")] + [0] * 5), (104, []), (105, [-0.0, 1]), (None, rows[0][1]), (1, rows[1][1])]
    docs = frame(spark, rows + hard)
    filled = [(i, v if v is None else list(v) + [0] * (6 - len(v))) for i, v in rows + hard]
    check(whitening.component_rows(docs, whitening.fit(docs)).collect(), filled)
    wide = whitening.whitened(docs, whitening.fit(docs))
    assert set(wide.columns) == {*docs.columns, "deviation"} and wide.count() == 64


def test_no_variance_and_empty(spark):
    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    got = whitening.component_rows(same, whitening.fit(same)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(got)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    two = frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])
    got = sorted(whitening.component_rows(two, whitening.fit(two)).collect())
    assert [r["whitened"] is None for r in got] == [False, True, True] * 2 and abs(got[0]["whitened"]) == pytest.approx(1) and got[0]["explained"] == pytest.approx(1)
    for rows in ([], [(1, None)], [(1, [])]):
        none = frame(spark, rows)
        assert whitening.component_rows(none, whitening.fit(none)).count() == 0


def test_exact_beyond_a_double(spark):
    rows = [(i, [1e9 + i * 4096, -3e9, 2.0**55]) for i in range(5)] + [(9, [3e38, 0, 0])]
    docs = frame(spark, rows)
    model = whitening.fit(docs)
    whole = lambda e: max(-(2**63), min(2**63 - 1, int(np.floor(256 * float(np.float32(e))))))
    x = [[whole(e) for e in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    sums = [sum(v[i] for v in fit) for i in range(3)]
    assert (model.n, model.sums) == (len(fit), sums)
    assert model.deviations(np.array(x, np.int64)) == [e if (e := sum((len(fit) * v - s) ** 2 for v, s in zip(row, sums))) < 2**63 else None for row in x]
    near = [[1, 2, 3], [2, 2, 5]]
    small = whitening.Model(3_000_000_000, [5, 6, 2**40], np.zeros(0), np.zeros((3, 0)), 0.0)
    assert small.deviations(np.array(near)) == [e if (e := sum((3_000_000_000 * v - s) ** 2 for v, s in zip(row, small.sums))) < 2**63 else None for row in near]
