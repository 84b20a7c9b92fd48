"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on windows of toxic and of ordinary
text; both stand over one background, a third dictionary trained on ordinary
windows, so that the two compressed lengths of a window differ by what only one
of the two explains. A toxic document is mostly ordinary text. The windows that
a dictionary is trained on are therefore chosen by the dictionaries of the round
before, crosswise, so that no document judges itself: of toxic documents those
that the toxic dictionary compresses better, of ordinary documents those that it
wrongly compresses better. No words are counted, listed or looked up.

A document's features are numbers of windows whose lengths differ by at least
so many bytes. Thresholds and weights are calibrated by a logistic curve on
labelled documents that no dictionary has seen, at the labels' own share of toxic
documents, where a missed toxic document counts as MISS_COST false alarms.

The model is fitted in a task, from at most max_toxic + max_ordinary labelled
documents, chosen by a hash of their ids; of a text over EXCERPT_FROM characters
ten evenly spaced pieces take part, of EXCERPT_FROM characters together. The driver
sees the dictionaries and weights only, no texts. Every document is scored, and whole.

Defined cases: a null or empty text gets the curve's value for no window; without
labelled documents of both kinds all scores are 0; a document labelled twice
counts as toxic if one label says so; labels of ids that the documents lack are
ignored; of several texts of one labelled id the least is taken; repeated rows
are scored each for itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import small_batches

MAX_TOXIC, MAX_ORDINARY, EXCERPT_FROM = 3000, 4000, 100_000
#: Words of a window, bytes after which a word is cut, and windows of one document that training looks at.
WORDS, LONGEST_WORD, TRAINING_WINDOWS = 4, 48, 1000
#: zstandard level, shortest match and depth of search; bytes of the background and of both dictionaries, by round.
LEVEL, MIN_MATCH, SEARCH, BACKGROUND, ROUNDS = 12, 3, 4, 32_768, (65_536, 16_384, 8_192, 4_096)
#: Further pairs of dictionaries, from halves of the documents, in the model and in the rounds, and the difference from which they are asked.
PAIRS, IN_ROUNDS, LOOK_AGAIN = 2, 2, 3
#: Bytes by which a window must differ to train the next round, and windows of a toxic document that do, at most.
APART, MOST = 3, 4
#: Windows that the background and the first ordinary dictionaries are trained on, at most.
BACKGROUND_WINDOWS = 60_000
STEPS = (2, 3, 4, 5, 6)
#: Fixed value: the last bytes before a zstandard dictionary's content, its repeat offsets 1, 4 and 8.
CONTENT_AFTER = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))
#: False alarms that a missed toxic document is worth.
MISS_COST = 3.0


def windows(text: str | None) -> Iterator[bytes]:
    """Runs of WORDS words one after another, lower-cased, with blanks around; words beyond LONGEST_WORD bytes are cut in pieces."""
    words = (text or "").lower().encode().split()
    if any(len(w) > LONGEST_WORD for w in words):
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    for i in range(0, len(words), WORDS):
        yield b" " + b" ".join(words[i : i + WORDS]) + b" "


@dataclass
class Model:
    """Dictionaries (the first pair from all documents, the others from halves of them) and the curve's weights."""

    background: bytes = b""
    ordinary: list[bytes] = field(default_factory=list)
    toxic: list[bytes] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def ready(self) -> Model:
        if self.known():
            self._pairs = [tuple(_compressor(self.background + d).compress for d in pair) for pair in zip(self.ordinary, self.toxic)]
            # a known start makes every window compress, else short ones may be stored as they are
            self._pad = self.background[-400:-368]
        return self

    def known(self) -> bool:
        return bool(self.toxic and self.toxic[0])

    def apart(self, window: bytes) -> float:
        """Bytes that the toxic dictionary saves over the ordinary one; where the first pair differs by LOOK_AGAIN or more, the mean of all pairs."""
        window = self._pad + window
        ordinary, toxic = self._pairs[0]
        d = len(ordinary(window)) - len(toxic(window))
        if d >= LOOK_AGAIN and len(self._pairs) > 1:
            d = (d + sum(len(a(window)) - len(b(window)) for a, b in self._pairs[1:])) / len(self._pairs)
        return d

    def features(self, text: str | None) -> list[float]:
        """Largest differences, numbers of windows by difference as they are and beside the text's length, and the mean."""
        counts, n, total = [0] * (STEPS[-1] + 1), 0, 0
        top, pad, (ordinary, toxic), apart = [0, 0, 0], self._pad, self._pairs[0], self.apart
        for w in windows(text):
            n += 1
            padded = pad + w
            d = len(ordinary(padded)) - len(toxic(padded))
            if d >= LOOK_AGAIN:
                d = apart(w)
            total += d
            if d > 0:
                counts[min(int(d + 0.5), STEPS[-1])] += 1
                if d > top[0]:
                    top = sorted([*top[1:], d])
        at_least = [sum(counts[s:]) for s in STEPS]
        size = math.sqrt(n + 1)
        return [1.0, float(min(top[2], 12)), min(sum(top) / 3, 12.0), *(math.log1p(c) for c in at_least), *(c / size for c in at_least[1:4]), math.log1p(n), total / (n + 1)]

    def score(self, text: str | None) -> float:
        if not self.known():
            return 0.0
        x = sum(w * f for w, f in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _compressor(raw: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(raw), source_size=32, min_match=MIN_MATCH, search_log=SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def trained(samples: list[bytes], size: int, segment: int = 16, d: int = 6) -> bytes:
    """Content of a zstandard dictionary of at most ``size`` bytes trained on samples; fewer samples than training takes stand for themselves."""
    import zstandard

    samples = list(samples)
    random.Random(7).shuffle(samples)
    try:
        # the tables in front of the content are cut off, also where it does not fill the size: both sides are compared by content alone
        return zstandard.train_dictionary(size + 300, samples, k=segment, d=d).as_bytes().partition(CONTENT_AFTER)[2][-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """Background, ordinary and toxic dictionary; each half of the documents chooses by the dictionaries of the other half."""
    looked_at = lambda x: [w for w, _ in zip(windows(x), range(TRAINING_WINDOWS))]
    toxic_half = [[looked_at(x) for x in toxic[i::2]] for i in (0, 1)]
    ordinary_half = [[w for x in ordinary[i::2] for w in looked_at(x)] for i in (0, 1)]
    for half in ordinary_half:
        random.Random(5).shuffle(half)
    background = trained([w for half in ordinary_half for w in half[: BACKGROUND_WINDOWS // 2]], BACKGROUND, 32, 8)
    chosen = toxic_half
    wrong = [half[: BACKGROUND_WINDOWS // 3] for half in ordinary_half]
    for i, size in enumerate(ROUNDS):
        models = [bagged(background, o, t, size, IN_ROUNDS).ready() for o, t in zip(wrong, chosen)]
        if not all(m.known() for m in models):
            break
        better = []
        for half, other in zip(toxic_half, models[::-1]):
            picked = []
            for doc in half:
                best = sorted(((other.apart(w), w) for w in doc), reverse=True)[: max(2, min(MOST, len(doc) // 4))]
                picked.append([w for d, w in best if d >= APART])
            better.append(picked)
        found = [[w for w in half if other.apart(w) >= APART] for half, other in zip(ordinary_half, models[::-1])]
        wrong = found if i == 0 else [a + b for a, b in zip(wrong, found)]
        chosen = better
    return bagged(background, wrong[0] + wrong[1], chosen[0] + chosen[1], ROUNDS[-1], PAIRS)


def bagged(background: bytes, ordinary: list[bytes], toxic: list[list[bytes]], size: int, pairs: int) -> Model:
    """Dictionaries from all windows (those of toxic text by document), and ``pairs`` more from random halves of them."""
    parts = [(ordinary, toxic)]
    for k in range(pairs // 2):
        some, docs = list(ordinary), list(toxic)
        rng = random.Random(k)
        rng.shuffle(some)
        rng.shuffle(docs)
        parts += [(some[i::2], docs[i::2]) for i in (0, 1)]
    return Model(background, [trained(o, size) for o, _ in parts], [trained([w for doc in t for w in doc], size) for _, t in parts])


def fit(rows: list[tuple[int, str, int]], share: float | None = None) -> Model:
    """Model from (id, text, toxic) rows: dictionaries from three quarters, the curve from the others, weighted to the given share of toxic documents (none: as they are)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    rest = [r for r in rows if not zlib.crc32(f"half {r[0]}".encode()) % 4]
    half = [r for r in rows if zlib.crc32(f"half {r[0]}".encode()) % 4]
    toxic, ordinary = ([x or "" for _, x, y in half if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        return Model()
    model = dictionaries(toxic, ordinary).ready()
    if not model.known():
        return Model()
    y = [float(k) for _, _, k in rest]
    n = [max(1.0, len(y) - sum(y)), max(1.0, sum(y))]
    share = sum(y) / max(1, len(y)) if share is None else share
    weights = [(MISS_COST * share / n[1] if k else (1 - share) / n[0]) * len(y) for k in y]
    model.weights = _logistic([model.features(t) for _, t, _ in rest] or [model.features("")], y or [0.0], weights or [1.0])
    return model


def _logistic(x, y, weights, penalty: float = 0.3) -> list[float]:
    import numpy as np

    x, y, c = np.array(x), np.array(y), np.array(weights)
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (c * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def remainder(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def excerpt(text: Column) -> Column:
    """A text of at most EXCERPT_FROM characters as it is; of a longer one ten evenly spaced pieces."""
    piece = EXCERPT_FROM // 10
    pieces = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.substr(text, F.lit(1) + F.floor((F.length(text) - piece) * i / 9).cast("int"), F.lit(piece)))
    return F.when(F.length(text) > EXCERPT_FROM, F.array_join(pieces, " ")).otherwise(F.coalesce(text, F.lit("")))


def sampled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> tuple[DataFrame, float | None]:
    """At most max_toxic + max_ordinary labelled documents outside the held-out fold, by a hash of their ids, and the share of toxic ones among all of them."""
    known = labels.where(remainder(id_col) != 0).groupBy(id_col).agg(F.max(label_col).alias("y")).where("y in (0, 1)")
    known = known.join(df.select(id_col), id_col, "left_semi")
    counts = known.agg(F.count("*"), F.sum("y")).first()
    some = [known.where(F.col("y") == k).orderBy(F.xxhash64(id_col), id_col).limit(n) for k, n in ((1, max_toxic), (0, max_ordinary))]
    ids = F.broadcast(some[0].unionByName(some[1]))  # bounded by the two limits
    texts = df.select(id_col, text_col).join(ids, id_col).groupBy(id_col, "y").agg(F.min(excerpt(F.col(text_col))).alias("x"))
    return texts.select(id_col, "x", "y"), counts[1] / counts[0] if counts[0] else None


def sample(df: DataFrame, labels: DataFrame, **names) -> tuple[list[tuple[int, str, int]], float | None]:
    """``sampled``, with its rows."""
    rows, share = sampled(df, labels, **names)
    return [tuple(r) for r in rows.collect()], share


def train(df: DataFrame, labels: DataFrame, **names) -> Model:
    """The model of the sample. One task fits it, as the sample is bounded and the driver may have little memory."""
    rows, share = sampled(df, labels, **names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))], share)
        parts = ([model.background], [model.ordinary], [model.toxic], [model.weights])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.float64())))], ["background", "ordinary", "toxic", "weights"])

    fitted = small_batches(rows).coalesce(1).mapInArrow(run, "background binary, ordinary array<binary>, toxic array<binary>, weights array<double>").collect()
    return Model(bytes(fitted[0][0]), *([bytes(d) for d in x] for x in fitted[0][1:3]), list(fitted[0][3])) if fitted else Model()


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's id, held_out, score and predicted."""
    spec = (model.background, model.ordinary, model.toxic, model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*spec).ready()
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [id_col, "held_out", "score", "predicted"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return small_batches(df).select(id_col, (remainder(id_col) == 0).alias("held_out"), text_col).mapInArrow(run, schema)


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df's rows whose score is below the threshold, with all their columns. Only texts go to Python, and only scores come back."""
    spec = (model.background, model.ordinary, model.toxic, model.weights)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*spec).ready()
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return small_batches(df).where(scores(F.col(text_col)) < threshold)
