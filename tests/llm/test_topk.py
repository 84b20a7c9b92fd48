import math
import random

from pyspark.sql import functions as F

from hypolake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3) for i, v in rows], SCHEMA)


def slow(rows, k=5):
    fit = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in fit:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, qv in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fit if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows):
    df = frame(spark, rows).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == slow(rows)


def test_against_brute_force(spark):
    rng = random.Random(10)
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(16)]) for i in range(400)])


def test_ties_repeated_rows_and_odd_vectors(spark):
    rng = random.Random(11)
    one = [0.5, -0.25, 0.125]
    rows = [(i, one) for i in range(120)] + [(300 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(100)]
    rows += [(7, one), (7, one), (50, one), (400, None), (401, []), (402, [None, 1.0, 0.0]), (403, [float("nan"), 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0]), (None, one), (405, [1.0, 2.0]), (450, [3.0, 1.0]), (500, [0.0, 0.0, 0.0])]
    check(spark, rows)


def test_large_values_and_few_rows(spark):
    check(spark, [(0, [3000.0, -2e6]), (1, [1e6, 1.0]), (50, [1.5e6, 2.5e6]), (2, [-1e6, 7.0])])
    check(spark, [(0, [0.5])])
    check(spark, [])
    assert topk.top_k(frame(spark, [(1, [0.5])]), frame(spark, [])).count() == 0


def test_top_rows_on_slices_are_a_superset():
    """The boundary holds every row that belongs to the result, for other widths of the index."""
    import numpy as np

    rng = np.random.default_rng(1)
    ids, values = np.arange(500), rng.integers(-300, 300, (500, 8))
    for bits in (1, 2, 5, 12):
        topk.KEPT_BITS, kept = bits, topk.KEPT_BITS
        try:
            block = topk.Block(ids, values)
            for q in range(0, 500, 97):
                got = [(s, i) for _, i, s in block.search(np.array([q]), values[[q]], 5)]
                want = sorted(((int(values[q] @ values[i]), i) for i in ids if i != q), key=lambda t: (-t[0], t[1]))[:5]
                assert got == want
        finally:
            topk.KEPT_BITS = kept


def test_query_set_is_checked_in_blocks(spark):
    rng = random.Random(12)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(600)]
    df = frame(spark, rows)
    topk.AT_ONCE, kept = 3, topk.AT_ONCE
    try:
        got = topk.top_k(df, df.where("vec_id % 50 = 0")).where(F.col("rank") == 1).count()
    finally:
        topk.AT_ONCE = kept
    assert got == 12


def test_many_groups_of_queries_and_stored_blocks(spark):
    import numpy as np

    rng = random.Random(12)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(0, 1500, 5)]
    df = frame(spark, rows).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), group_bytes=500)
    assert sorted(tuple(r) for r in got.collect()) == slow(rows)
    # groups were searched and written one after another: the result is a table, without their plans and broadcasts
    assert "Broadcast" not in got._jdf.queryExecution().toString() and "Union" not in got._jdf.queryExecution().toString()
    for top in (90, 20_000, 1 << 40):
        values = np.array([[rng.randint(-top, top) for _ in range(5)] for _ in range(200)])
        block = topk.Block(np.arange(200), values)
        again = topk.Block.unpacked(5, *block.packed())
        assert (again.values == block.values).all() and (again.slices == block.slices).all() and (again.real == block.real).all()
        assert list(again.search(np.array([3]), values[3:4], 5)) == list(block.search(np.array([3]), values[3:4], 5))

