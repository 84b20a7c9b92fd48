"""Ranking and calibration metrics of predictions (p in [0, 1], y boolean), and intervals by resampling.

All take a DataFrame with columns p and y (rows with a null p are left out) and
optional group columns, and give a row for each group. Rows are counted by
distinct score first; running totals over the scores are dealt by ranges, so the
work is a few shuffles of counts, not a loop over pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.functions import draws
from hypolake.operators.lineage import cut
from hypolake.operators.relational import with_running_totals

#: Widths of the ranges by which scores and keys of rows are dealt.
SCORE_WIDTH, KEY_WIDTH = 1 / 1024, 65_536.0
#: Draws that are hashed together, stretches of a task, and draws that are counted at once.
STRETCH, DRAWS, TURNS, CACHED = 1_000_000, 2_000_000, 10, 65_536


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col("p").isNotNull() & F.col("y").isNotNull())


def by_score(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each distinct score."""
    y = F.col("y").cast("long")
    return _known(df).groupBy(*by, "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M1: (wins + ties / 2) / (positives * negatives); null if a class is empty."""
    rows = with_running_totals(by_score(df, by), by, "p", ["neg"], SCORE_WIDTH)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))
    return rows.groupBy(*by).agg((wins / pairs).alias("auc"))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M2: mean squared difference."""
    return _known(df).groupBy(*by).agg(F.avg(F.pow(F.col("y").cast("double") - F.col("p"), F.lit(2.0))).alias("brier"))


def top_sizes(n: Column, share: float) -> Column:
    """Rows in the top share: rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))


def _top(df: DataFrame, shares: Sequence[float], by: Sequence[str], neutral: bool) -> DataFrame:
    """For each share: rows k and positives among the k best. Ties go to positives first, or, neutral, count in proportion."""
    scores = by_score(df, by).withColumn("both", F.col("pos") + F.col("neg"))
    rows = with_running_totals(scores, by, "p", ["both"], SCORE_WIDTH, descending=True).withColumnRenamed("before_both", "before")
    sizes = _known(df).groupBy(*by).agg(F.count("*").alias("n_all"))
    rows = rows.join(sizes, list(by)) if by else rows.crossJoin(sizes)  # one row without groups
    out = []
    for i, share in enumerate(shares):
        room = F.greatest(F.lit(0), top_sizes(F.col("n_all"), share) - F.col("before"))
        taken = F.least(room, F.col("pos") + F.col("neg"))
        hit = taken * F.col("pos") / (F.col("pos") + F.col("neg")) if neutral else F.least(room, F.col("pos"))
        out += [F.sum(hit).cast("double").alias(f"hit{i}"), F.max(top_sizes(F.col("n_all"), share)).alias(f"k{i}")]
    return rows.groupBy(*by).agg(*out, F.sum("pos").alias("positives"), F.max("n_all").alias("n_all"))


def ranking(df: DataFrame, by: Sequence[str] = (), neutral: bool = False) -> DataFrame:
    """M3 to M5: recall at 5, 10 and 20 %, precision at 10 %, and the rate in the top tenth and quarter over that of the rest."""
    shares = (0.05, 0.10, 0.20, 0.25)
    t = _top(df, shares, by, neutral)
    recall = lambda i: F.when(F.col("positives") == 0, 0.0).otherwise(F.col(f"hit{i}") / F.nullif(F.col("positives").cast("double"), F.lit(0.0)))

    def rs(i: int) -> Column:
        rest = (F.col("positives") - F.col(f"hit{i}")) / F.nullif((F.col("n_all") - F.col(f"k{i}")).cast("double"), F.lit(0.0))
        return F.col(f"hit{i}") / F.col(f"k{i}").cast("double") / F.nullif(rest, F.lit(0.0))

    tail = "_tie_neutral" if neutral else ""
    columns = {"recall_at_5pct": recall(0), "recall_at_10pct": recall(1), "recall_at_20pct": recall(2), "precision_at_10pct": F.col("hit1") / F.col("k1").cast("double"), "rs_top_decile": rs(1), "rs_top_quartile": rs(3)}
    return t.select(*by, *[c.alias(k + tail) for k, c in columns.items()])


def ece(df: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """M6: weighted gap of mean score and rate over equal bins, the last one closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    rows = _known(df).groupBy(*by, b).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg(F.col("y").cast("double")).alias("my"))
    return rows.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def mrr(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of 1 / rank over the positives; equal scores share the smallest rank of their tie. Null without positives."""
    scores = by_score(df, by).withColumn("both", F.col("pos") + F.col("neg"))
    rows = with_running_totals(scores, by, "p", ["both"], SCORE_WIDTH, descending=True)
    return rows.groupBy(*by).agg((F.sum(F.col("pos") / (F.col("before_both") + 1)) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("mrr"))


def calibration_slope(df: DataFrame, by: Sequence[str] = (), steps: int = 25, tolerance: float = 1e-10, edge: float = 1e-6) -> DataFrame:
    """Intercept and slope of y ~ logit(p) of each group; slope 1 and intercept 0 where scores are calibrated.

    Newton's steps from (0, 0), each one aggregation of the distinct scores to five sums a group; scores are held
    ``edge`` away from 0 and 1. Null where a class is missing, all scores are one, or the steps do not settle
    (scores that part the classes).
    """
    p = F.least(F.greatest(F.col("p"), F.lit(edge)), F.lit(1 - edge))
    scores = cut(by_score(df, by).withColumn("x", F.log(p / (1 - p))).withColumn("n", (F.col("pos") + F.col("neg")).cast("double")))
    now = scores.groupBy(*by).agg(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(False).alias("done"))
    eta = F.col("a") + F.col("b") * F.col("x")
    q = 1 / (1 + F.exp(-eta))
    w, r, x = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q, F.col("x")
    total = lambda c, name: F.sum(c).alias(name)
    for _ in range(steps):
        other = now.withColumnsRenamed({c: f"_{c}" for c in by})
        joined = scores.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else scores.crossJoin(other)  # one row without groups
        sums = joined.groupBy(*by, "a", "b", "done").agg(total(w, "s0"), total(w * x, "s1"), total(w * x * x, "s2"), total(r, "g0"), total(r * x, "g1"))
        # a matrix that is singular but for rounding has no solution
        det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        det = F.when(det > 1e-12 * F.col("s0") * F.col("s2"), det)
        da, db = (F.col("s2") * F.col("g0") - F.col("s1") * F.col("g1")) / det, (F.col("s0") * F.col("g1") - F.col("s1") * F.col("g0")) / det
        still = ~F.col("done")
        step = lambda old, d: F.when(still, F.col(old) + d).otherwise(F.col(old)).alias(old)
        settled = F.coalesce(F.greatest(F.abs(da), F.abs(db)) <= tolerance, F.lit(False))
        now = cut(sums.select(*by, step("a", da), step("b", db), (F.col("done") | settled | det.isNull()).alias("done")))
        if now.where(~F.col("done")).isEmpty():
            break
    ok = F.col("done") & (F.abs("b") < 1e6)
    return now.select(*by, F.when(ok, F.col("a")).alias("calibration_intercept"), F.when(ok, F.col("b")).alias("calibration_slope"))


def calibration(df: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """N, mean score, observed rate and gap of each bin from 1; a score of 1 has a bin of its own after the last."""
    rows = df.where(F.col("p").isNotNull()).groupBy(*by, F.width_bucket("p", F.lit(0.0), F.lit(1.0), F.lit(bins)).cast("int").alias("bin"))
    out = rows.agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg(F.when(F.col("y"), 1.0).otherwise(0.0)).alias("observed_rate"))
    return out.withColumn("calibration_gap", F.round(F.col("observed_rate") - F.col("mean_predicted"), 3))


def _drawn(seed: int):
    """The draws of a stretch: for each block of rows, the places of the drawn ones in it, as 16-bit numbers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for line in batch.to_pylist():
                rows = draws.rows(draws.numbers(f"{seed}:{line['rep']}:", line["first"], min(DRAWS, line["n"] - line["first"])), line["n"])
                block = rows >> np.uint32(16)
                order = np.argsort(block.astype(np.uint16) if line["n"] <= 1 << 32 else block, kind="stable")  # numbers of 16 bits are sorted digit by digit
                sizes = np.bincount(block)
                found = np.flatnonzero(sizes)
                ends = np.concatenate([[0], np.cumsum(sizes[found])]) * 2
                places = (rows & np.uint32(0xFFFF)).astype("<u2")[order]
                at = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(places)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), line["_run"], np.int64)), pa.array(found.astype(np.int64)), pa.array(np.full(len(found), line["rep"], np.int32)), at], ["_run", "block", "rep", "at"])

    return run


def _weighed(taken, rows):
    """How often each resample draws each (score, class) of a block of rows: by 65,536 of these, their numbers and counts."""
    import numpy as np
    import pyarrow as pa

    names = ["_run", "rep", "part", "codes", "counts"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    if not taken.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    codes = np.zeros(1 << 16, np.int64)
    codes[rows["at"].to_numpy()] = rows["code"].to_numpy()
    codes, code = np.unique(codes, return_inverse=True)
    weights: dict[int, np.ndarray] = {}
    for rep, at in zip(taken["rep"].to_pylist(), taken["at"].to_pylist()):
        one = np.bincount(code[np.frombuffer(at, "<u2")], minlength=len(codes))
        weights[rep] = weights[rep] + one if rep in weights else one
    tables = []
    for rep, one in weights.items():
        used = np.flatnonzero(one)
        part = codes[used] >> 16
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(starts, len(used))
        binary = lambda values, width: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])  # noqa: E731, B023
        tables.append(pa.table([pa.array(np.full(len(starts), taken["_run"][0].as_py(), np.int64)), pa.array(np.full(len(starts), rep, np.int32)), pa.array(part[starts]), binary((codes[used] & 0xFFFF).astype("<u2"), 2), binary(one[used].astype("<u4"), 4)], names))
    return pa.concat_tables(tables)


def _wins(group):
    """Of one resample and 32,768 scores: positives, negatives, and wins and half ties among them."""
    import numpy as np
    import pyarrow as pa

    n = np.zeros(1 << 16, np.int64)
    for codes, counts in zip(group["codes"].to_pylist(), group["counts"].to_pylist()):
        n[np.frombuffer(codes, "<u2")] += np.frombuffer(counts, "<u4")  # codes of one row differ
    neg, pos = n[0::2].astype(float), n[1::2].astype(float)
    wins = float((pos * (np.cumsum(neg) - neg / 2)).sum())
    return pa.table({"_run": group["_run"][:1], "rep": group["rep"][:1], "part": group["part"][:1], "pos": pa.array([pos.sum()]), "neg": pa.array([neg.sum()]), "wins": pa.array([wins])})


def resampled_auc(df: DataFrame, by: Sequence[str], key: str, reps: int, seed: int = 42) -> DataFrame:
    """AUC of resamples with replacement, by group and rep: draw i of a resample takes the row whose number (by the numeric, distinct ``key``) is md5(seed:rep:i) modulo n. The draws do not depend on the order of rows or on partitions.

    Draws travel packed, two bytes each, to blocks of 65,536 rows, and from there as counts of scores, so that a
    task holds a stretch of draws, or all draws of one block, or the counts of one resample.
    """
    from pyspark.sql import Window

    rows = _known(df).select(*by, F.col("p").cast("double").alias("p"), F.col("y").cast("int").alias("y"), key)
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("_run", F.monotonically_increasing_id()))
    numbered = with_running_totals(rows.withColumn("one", F.lit(1)), by, key, ["one"], KEY_WIDTH).withColumnRenamed("before_one", "row")
    places = with_running_totals(by_score(df, by).select(*by, F.col("p").cast("double").alias("p"), F.lit(1).alias("one")), by, "p", ["one"], SCORE_WIDTH)
    coded = numbered.drop("one").join(places.select(*by, "p", "before_one"), [*by, "p"])
    coded = coded.join(sizes.drop("n"), list(by)) if by else coded.crossJoin(sizes.drop("n"))  # one row without groups
    coded = coded.select("_run", F.expr("row div 65536").alias("block"), (F.col("row") % 65536).cast("int").alias("at"), (F.col("before_one") * 2 + F.col("y")).alias("code"))
    stretches = sizes.where("n > 0").select("_run", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS).cast("long"))).alias("first"))
    stretches = stretches.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    tasks = max(1, stretches.count() // TURNS, min(stretches.count(), rows.sparkSession.sparkContext.defaultParallelism))
    taken = stretches.repartition(tasks).mapInArrow(_drawn(seed), "_run long, block long, rep int, at binary")
    weighed = taken.groupBy("_run", "block").cogroup(coded.groupBy("_run", "block")).applyInArrow(_weighed, "_run long, rep int, part long, codes binary, counts binary")
    parts = weighed.groupBy("_run", "rep", "part").applyInArrow(_wins, "_run long, rep int, part long, pos double, neg double, wins double")
    before = Window.partitionBy("_run", "rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 32,768 scores
    parts = parts.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    auc_of = F.sum(F.col("wins") + F.col("pos") * F.col("below")) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return parts.groupBy("_run", "rep").agg(auc_of.alias("auc")).join(sizes, "_run").select(*by, "rep", "auc")


def interval(values: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """lo and hi: the values at int(2.5 %) and int(97.5 %) of the sorted resamples (from 0)."""
    rows = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))  # one value for each resample
    at = lambda q: F.get("v", F.floor(F.size("v") * q).cast("int"))
    return rows.select(*by, at((1 - level) / 2).alias(f"{value}_lo"), at((1 + level) / 2).alias(f"{value}_hi"))


def bootstrap_auc(df: DataFrame, key: str, by: Sequence[str] = (), reps: int = 200, seed: int = 42) -> DataFrame:
    """M7: AUC with its interval."""
    lows = interval(resampled_auc(df, by, key, reps, seed), "auc", by)
    point = auc(df, by)
    return point.join(lows, list(by), "left") if by else point.crossJoin(lows)  # one row each


def all_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """M1 to M6 of each group."""
    counts = _known(df).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.sum(F.col("y").cast("long")).alias("n_approved"))
    out = counts
    for part in (auc(df, by), brier(df, by), ranking(df, by), ece(df, by)):
        out = out.join(part, list(by), "left")
    return out


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """M8: a d / (b c), with 0.5 added to all cells if one is 0."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    return (a + add) * (d + add) / ((b + add) * (c + add))


def odds_ratio_intervals(cells: DataFrame, by: Sequence[str], reps: int = 500, seed: int = 42, least: int = 20) -> DataFrame:
    """M8: odds ratio and interval from 2 x 2 cells (high_approved, high_failed, low_approved, low_failed); null below ``least`` cases. Draws fall into the cells by the hash of their number.

    A draw's hash is the same for all rows of cells, so that stretches of draws are dealt, hashed once and counted for every row.
    """
    names = ("high_approved", "high_failed", "low_approved", "low_failed")
    total = sum(F.col(x) for x in names)
    rows = cut(cells.select(*by, *[F.col(x).cast("double").alias(x) for x in names]).withColumn("n_covered", total.cast("long")).withColumn("_row", F.monotonically_increasing_id()))
    bounds = [F.ceil(sum((F.col(x) for x in names[:k]), F.lit(0.0))).alias(f"b{k}") for k in (1, 2, 3)]
    some = rows.where(F.col("n_covered") >= least).select("_row", F.col("n_covered").alias("n"), *bounds)
    longest = some.agg(F.max("n")).first()[0] or 0
    parts = -(-longest // STRETCH)
    stretches = rows.sparkSession.range(0, parts * reps, 1, max(1, min(parts * reps, -(-parts * reps // TURNS)))).select((F.col("id") % reps).cast("int").alias("rep"), (F.floor(F.col("id") / reps) * STRETCH).alias("first"))
    # a row for each cohort and dimension goes with every stretch
    every = F.broadcast(some.agg(F.collect_list(F.struct("_row", "n", "b1", "b2", "b3")).alias("cells")))
    counted = stretches.crossJoin(every).mapInArrow(_falls(seed), "_row long, rep int, c0 long, c1 long, c2 long, c3 long")
    counted = counted.groupBy("_row", "rep").agg(*[F.sum(f"c{k}").cast("double").alias(f"c{k}") for k in range(4)])
    ratios = counted.withColumn("odds_ratio", odds_ratio(*[F.col(f"c{k}") for k in range(4)]))
    point = rows.withColumn("odds_ratio", F.when(F.col("n_covered") >= least, odds_ratio(*[F.col(x) for x in names])))
    return point.join(interval(ratios, "odds_ratio", ["_row"]), "_row", "left").drop("_row")


def _falls(seed: int):
    """How many draws of a stretch fall into each of the cells, for every row of cells."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for line in batch.to_pylist():
                cells = [c for c in line["cells"] if c["n"] > line["first"]]
                if not cells:
                    continue
                hashes = draws.numbers(f"{seed}:{line['rep']}:", line["first"], min(STRETCH, max(c["n"] for c in cells) - line["first"]))
                below = np.zeros((len(cells), 5), np.int64)
                for at in range(0, len(hashes), CACHED):
                    for i, c in enumerate(cells):
                        x = draws.rows(hashes[at : max(at, min(at + CACHED, c["n"] - line["first"]))], c["n"])
                        below[i, 1:] += [*(np.count_nonzero(x < c[f"b{k}"]) for k in (1, 2, 3)), len(x)]
                falls = np.diff(below, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([c["_row"] for c in cells], pa.int64()), pa.array([line["rep"]] * len(cells), pa.int32()), *[pa.array(falls[:, k]) for k in range(4)]], ["_row", "rep", "c0", "c1", "c2", "c3"])

    return run
