"""Gradient-boosted trees with monotone constraints, grown level by level from histograms.

Features are cut into bins once, at quantiles over all rows. A level of a tree is one aggregation: tasks sum
gradients, second derivatives and counts by (model, node, feature, bin), and the sums, whose number does not
depend on the rows, come to the driver, which chooses the splits. Several models that differ in their rows, as
those of folds, grow side by side in the same aggregations.

A split on a constrained feature is refused where its sides' values run against the feature's sign; where it is
taken, the middle of the two values bounds all values below: so every tree, and their sum, rises or falls
in the feature. Unknown values go to the side where they fit best.

Defined cases: without rows, or with rows of one class only, a model has no trees and every score is 0.5; a feature
without any value is never split; rows with a null label take no part in the fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.operators.lineage import cut

#: Features whose effect has a known direction.
SIGNS = {
    "mendelian_n": 1,
    "mendelian_n_dominant": 1,
    "mendelian_n_recessive": 1,
    "clingen_n_strong": 1,
    "ot_genetic_max": 1,
    "ot_somatic_score_max": 1,
    "family_approved_count": 1,
    "gene_approved_count": 1,
    "depmap_pan_essential": -1,
    "gnomad_pli": -1,
}

#: Trees after which the rows' margins are written down, so that a pass applies no more than these.
REFRESH = 20
#: Models that one fit holds, as a row's models are bits of a long.
MOST_MODELS = 62
NOTHING = 1e-9


@dataclass(frozen=True)
class Settings:
    rounds: int = 60
    depth: int = 4
    step: float = 0.1
    bins: int = 32
    least_rows: int = 50
    l1: float = 1.0
    l2: float = 1.0
    columns: float = 0.6
    signs: Mapping[str, int] = field(default_factory=dict)
    seed: int = 42


#: The plain and the regularised setting; rounds * step of the second is that of 200 rounds of 0.03.
PLAIN = Settings(rounds=150, depth=6, step=0.1, least_rows=20, l1=0.1, l2=0.1, columns=0.8)
ROBUST = Settings(signs=SIGNS)


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2 i + 1 and 2 i + 2; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    unknown_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def root(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where rows of bins (0: unknown) end up."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        while True:
            f = self.feature[at]
            if not (inner := f >= 0).any():
                return at
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == 0, self.unknown_left[at], b <= self.threshold[at])
            at = np.where(inner, 2 * at + 2 - left, at)


@dataclass
class Ensemble:
    names: list[str]
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bin of each value from 1, by the first cut that is not below it; 0 for NaN."""
        out = np.zeros(values.shape, np.int16)
        for j, c in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(values[:, j]), 0, np.searchsorted(c, values[:, j], side="left") + 1)
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees:
            out += t.value[t.nodes(bins)]
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(self.bins(values))))


@dataclass
class Split:
    feature: int
    threshold: int
    unknown_left: bool
    left: float
    right: float


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _leaf(g: np.ndarray, h: np.ndarray, s: Settings, low: float, high: float) -> np.ndarray:
    """Best value of a node for its sums, within its bounds."""
    return np.clip(-np.sign(g) * np.maximum(np.abs(g) - s.l1, 0) / (h + s.l2), low, high)


def _loss(g: np.ndarray, h: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    return g * w + (h + s.l2) * w * w / 2 + s.l1 * np.abs(w)


def best_split(sums: np.ndarray, signs: np.ndarray, s: Settings, low: float, high: float) -> Split | None:
    """Best split of a node by its sums (feature, bin, [gradient, second derivative, rows]); None where nothing is gained. Of equal splits the first feature's lowest is taken."""
    total = sums[0].sum(axis=0)
    known = np.cumsum(sums[:, 1:-1], axis=1)
    unknown = sums[:, :1]
    # unknown values on the left side, or on the right
    left = np.stack([known + unknown, known], axis=2)
    right = total - left
    wl, wr = (_leaf(x[..., 0], x[..., 1], s, low, high) for x in (left, right))
    before = _loss(total[0], total[1], _leaf(total[0], total[1], s, low, high), s)
    gain = before - _loss(left[..., 0], left[..., 1], wl, s) - _loss(right[..., 0], right[..., 1], wr, s)
    fits = (left[..., 2] >= s.least_rows) & (right[..., 2] >= s.least_rows) & (signs[:, None, None] * (wr - wl) >= 0)
    gain = np.where(fits, gain, -np.inf)
    if not gain.size or not (best := gain.max()) > NOTHING:
        return None
    f, t, side = np.unravel_index(np.flatnonzero(gain.ravel() >= best - NOTHING * max(1.0, best))[0], gain.shape)
    return Split(int(f), int(t) + 1, side == 0, float(wl[f, t, side]), float(wr[f, t, side]))


def quantile_cuts(df: DataFrame, names: Sequence[str], bins: int) -> list[list[float]]:
    """At most bins - 1 cuts for each feature, at quantiles of all known values; a feature's greatest value is no cut."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(names)], *[F.max(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return [sorted({float(v) for v in found[f"q{i}"] or () if v < found[f"m{i}"]}) for i in range(len(names))]


def _binned(df: DataFrame, ensemble: Ensemble, keep: Sequence[Column]) -> DataFrame:
    """Bins of the features (array<smallint>), and what else is asked for."""

    @F.pandas_udf("array<smallint>")
    def bins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(list(ensemble.bins(_stacked(values, len(ensemble.names)))), dtype=object)

    return df.select(bins(_vector(ensemble.names)).alias("bins"), *keep)


def _vector(names: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names])


def _stacked(values: pd.Series, width: int) -> np.ndarray:
    return np.stack(values.to_list()) if len(values) else np.zeros((0, width))


class _Growth:
    """Models that grow side by side over one table of bins, label, models (bits) and margins."""

    def __init__(self, rows: DataFrame, ensembles: list[Ensemble], s: Settings):
        self.ensembles, self.s, self.n = ensembles, s, len(ensembles)
        self.width = len(ensembles[0].names)
        self.signs = np.array([s.signs.get(c, 0) for c in ensembles[0].names])
        self.most = max((len(c) for c in ensembles[0].cuts), default=0) + 2
        self.rows = cut(rows)
        sums = [F.sum(F.when(F.col("models").bitwiseAND(1 << m) != 0, F.col("label"))).alias(f"p{m}") for m in range(self.n)]
        counts = [F.count(F.when(F.col("models").bitwiseAND(1 << m) != 0, 1)).alias(f"n{m}") for m in range(self.n)]
        got = self.rows.agg(*sums, *counts).first()
        # classes in balance: n / (2 n of the class)
        self.weights = np.zeros((self.n, 2))
        for m in range(self.n):
            n, p = got[f"n{m}"], got[f"p{m}"] or 0.0
            if 0 < p < n:
                self.weights[m] = n / (2 * (n - p)), n / (2 * p)
        self.live = [m for m in range(self.n) if self.weights[m].any()]
        self.fresh: list[list[Tree]] = [[] for _ in range(self.n)]

    def sums(self, growing: list[Tree], frontier: list[list[int]], used: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
        """Sums by feature and bin of each open node of each model: one aggregation over all rows."""
        width, most, weights, fresh, live = self.width, self.most, self.weights, self.fresh, self.live
        starts, cells = {}, 0
        for m in live:
            for node in frontier[m]:
                starts[m, node] = cells
                cells += len(used[m]) * most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((cells, 3))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = _matrix(batch.column(0), width)
                label, models = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                margins = _matrix(batch.column(3), len(weights))
                for m in live:
                    if not frontier[m]:
                        continue
                    mine = (models >> m) & 1 == 1
                    b, y = bins[mine].astype(np.int64), label[mine]
                    margin = margins[mine, m] + sum(t.value[t.nodes(b)] for t in fresh[m])
                    p, w = 1 / (1 + np.exp(-margin)), weights[m][y.astype(int)]
                    place = np.full(len(growing[m].feature), -1, np.int64)
                    for node in frontier[m]:
                        place[node] = starts[m, node]
                    at = place[growing[m].nodes(b)]
                    inside, columns = at >= 0, used[m]
                    where = (at[inside, None] + np.arange(len(columns)) * most + b[inside][:, columns]).ravel()
                    for k, v in enumerate((w * (p - y), w * p * (1 - p), np.ones(len(y)))):
                        out[:, k] += np.bincount(where, np.repeat(v[inside], len(columns)), cells)
            filled = np.flatnonzero(out[:, 2])
            columns = [pa.array(filled, pa.int64()), *[pa.array(out[filled, k]) for k in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "g", "h", "n"])

        parts = self.rows.mapInArrow(run, "cell long, g double, h double, n double")
        got = parts.groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow()
        every = np.zeros((cells, 3))
        for k in range(3):
            every[got.column(0).to_numpy(), k] = got.column(k + 1).to_numpy()
        return {(m, node): every[a : a + len(used[m]) * most].reshape(len(used[m]), most, 3) for (m, node), a in starts.items()}

    def grow(self, number: int) -> None:
        """One tree more for every model."""
        s = self.s
        growing = [Tree.root(s.depth) for _ in range(self.n)]
        used = []
        for m in range(self.n):
            rng = np.random.default_rng((s.seed, number, m))
            used.append(np.sort(rng.choice(self.width, max(1, round(s.columns * self.width)), replace=False)))
        bounds = [{0: (-np.inf, np.inf)} for _ in range(self.n)]
        frontier = [[0] if m in self.live else [] for m in range(self.n)]
        for _ in range(s.depth):
            if not any(frontier):
                break
            found = self.sums(growing, frontier, used)
            opened: list[list[int]] = [[] for _ in range(self.n)]
            for (m, node), sums in found.items():
                low, high = bounds[m][node]
                tree, split = growing[m], best_split(sums, self.signs[used[m]], s, low, high)
                if node == 0 and split is None:
                    g, h, _ = sums[0].sum(axis=0)
                    tree.value[0] = s.step * float(_leaf(g, h, s, low, high))
                if split is None:
                    continue
                f, left, right = int(used[m][split.feature]), 2 * node + 1, 2 * node + 2
                tree.feature[node], tree.threshold[node], tree.unknown_left[node] = f, split.threshold, split.unknown_left
                tree.value[left], tree.value[right] = s.step * split.left, s.step * split.right
                middle, sign = (split.left + split.right) / 2, self.signs[f]
                bounds[m][left] = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
                bounds[m][right] = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
                opened[m] += [left, right]
            frontier = opened
        for m in self.live:
            self.ensembles[m].trees.append(growing[m])
            self.fresh[m].append(growing[m])
        if len(self.fresh[self.live[0]]) >= REFRESH:
            self.refresh()

    def refresh(self) -> None:
        """Adds the last trees to the rows' margins and cuts the lineage."""
        width, fresh, n = self.width, self.fresh, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, margins = _matrix(batch.column(0), width), _matrix(batch.column(3), n).copy()
                for m in range(n):
                    for t in fresh[m]:
                        margins[:, m] += t.value[t.nodes(bins)]
                ends = pa.array(np.arange(0, margins.size + 1, n), pa.int32())
                margin = pa.ListArray.from_arrays(ends, pa.array(margins.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], margin], batch.schema.names)

        self.rows = cut(self.rows.mapInArrow(run, self.rows.schema))
        self.fresh = [[] for _ in range(n)]


def fit(df: DataFrame, names: Sequence[str], models: Column, n_models: int, settings: Settings = ROBUST, label: str = "label") -> list[Ensemble]:
    """Models from the rows whose bits in ``models`` (a long: bit m for model m) are set."""
    if not 0 < n_models <= MOST_MODELS:
        raise ValueError(f"between 1 and {MOST_MODELS} models at a time")
    names, rows = list(names), df.where(F.col(label).isNotNull())
    cuts = quantile_cuts(rows, names, settings.bins)
    ensembles = [Ensemble(names, cuts) for _ in range(n_models)]
    margins = F.array_repeat(F.lit(0.0), n_models).alias("margins")
    growth = _Growth(_binned(rows, ensembles[0], [F.col(label).cast("double").alias("label"), models.cast("long").alias("models"), margins]), ensembles, settings)
    if growth.live:
        for number in range(settings.rounds):
            growth.grow(number)
    return ensembles


def scored(df: DataFrame, ensembles: Sequence[Ensemble], which: Column | None = None, name: str = "p") -> DataFrame:
    """df with the score of the model that ``which`` numbers (none: the first)."""
    names = ensembles[0].names

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, number in batches:
            x, model, out = _stacked(values, len(names)), number.to_numpy(), np.zeros(len(values))
            for m in np.unique(model):
                out[model == m] = ensembles[m].scores(x[model == m])
            yield pd.Series(out)

    return df.withColumn(name, score(_vector(names), which if which is not None else F.lit(0)))


def boosted(settings: Settings = ROBUST) -> Callable[[DataFrame, Sequence[str]], Callable[[DataFrame], DataFrame]]:
    """A maker of one model, as those of ``ml``."""

    def make(df: DataFrame, names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
        model = fit(df, names, F.lit(1), 1, settings)
        return lambda rows: scored(rows, model)

    return make


def out_of_fold(df: DataFrame, names: Sequence[str], k: int = 5, settings: Settings = ROBUST, fold: str = "fold") -> DataFrame:
    """df with p, each fold scored by the model of the others; the k models grow side by side."""
    others = F.expr(f"{(1 << k) - 1}L - shiftleft(1L, `{fold}`)")
    return scored(df, fit(df, names, others, k, settings), F.col(fold))


def calibrated_out_of_fold(
    df: DataFrame, names: Sequence[str], k: int = 5, inner: int = 3, settings: Settings = ROBUST, fold: str = "fold", inner_fold: str = "inner"
) -> DataFrame:
    """L6, isotonic: each fold's score is the mean of ``inner`` models, each calibrated on rows of the other folds that it has not seen.

    All k * inner models grow side by side: a row trains those whose outer fold and inner fold are both others than its own.
    """
    from hypolake.plans.ml import isotonic

    bits = [F.when((F.col(fold) != o) & (F.col(inner_fold) != i), 1 << (o * inner + i)).otherwise(0) for o in range(k) for i in range(inner)]
    models = fit(df, names, sum(bits, F.lit(0).cast("long")), k * inner, settings)
    out = None
    for o in range(k):
        part = df.where(F.col(fold) == o)
        for i in range(inner):
            model = [models[o * inner + i]]
            curve = isotonic(scored(df.where((F.col(fold) != o) & (F.col(inner_fold) == i)), model))
            part = curve(scored(part, model)).withColumnRenamed("p", f"_p{i}")
        mean = sum((F.col(f"_p{i}") for i in range(inner)), F.lit(0.0)) / inner
        part = part.withColumn("p", mean).drop(*[f"_p{i}" for i in range(inner)])
        out = part if out is None else out.unionByName(part)
    return out
