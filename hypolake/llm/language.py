"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; what is neither letter nor mark becomes one space. Their n-grams of one to four
characters are hashed into a fixed number of buckets, weighted by log(1 + count) * idf and scaled to length
one. Document frequencies are counted over all labelled documents, in the tasks that hold them. The
weights are trained by follow-the-regularised-leader (FTRL-proximal) with an L1 and an L2 penalty, from
a bounded sample of labelled documents; one temperature is then fitted on sampled documents that took
no part in that. A prediction is the likeliest language and its calibrated probability.

Bounds of the fit, all parameters: ``max_labelled`` documents and ``max_bytes`` bytes of texts, in equal
shares for each language, and the ``max_languages`` most frequent languages. A text is taken whole or not
at all: one that is longer than its language's share of bytes takes no part in the sample (but counts in the
document frequencies, and is predicted like any other). Counts of long texts are added up piece by piece.

Defined cases: a text that is null or has no letter is ``und``, with score 0; so is every text where no
labelled document is to be learned from; with one language to learn each text has it, with score 1; repeated
rows are scored alike and count as often as they are there; a row without id is learned from like one of
another remainder; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import small_batches

UNKNOWN = "und"
BUCKET_BITS, ORDERS = 17, 4
MAX_LABELLED, MAX_BYTES, MAX_LANGUAGES = 3200, 16_000_000, 200
#: Characters of a text that are counted at once.
PIECE = 1_000_000
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 0.02, 0.1, 4


@cache
def _folded() -> np.ndarray:
    """For each code point: 32, or for a letter or mark its small letter, plus 2^31 for a letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            small = chr(point).lower()
            out[point] = (ord(small) if len(small) == 1 else point) | (1 << 31 if kind == "L" else 0)
    return out


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a text's n-grams, in order, and how often each occurs; none for a text without letters."""
    total, lettered = np.zeros(1 << BUCKET_BITS, np.int64), False
    text, tail = f" {text or ''} ", np.zeros(0, np.uint32)
    for at in range(0, len(text), PIECE):
        # the last signs of a piece stay in front of the next one, for the n-grams that began there
        folded = _folded()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        lettered = lettered or bool((folded >> 31).any())
        signs, first = np.append(tail, folded & 0x7FFFFFFF).astype(np.uint32), len(tail)
        again = np.zeros(len(signs), bool)
        again[1:] = (signs[1:] == 32) & (signs[:-1] == 32)
        signs = signs[~again]
        if len(signs) == first:
            continue
        hashed, mixed = np.zeros(len(signs), np.uint32), []
        for order in range(1, ORDERS + 1):
            if len(signs) < order:
                break
            hashed = hashed[: len(signs) - order + 1] * np.uint32(0x01000193) + signs[order - 1 :] + np.uint32(order)
            new = hashed[max(0, first - order + 1) :]
            mixed.append((new ^ (new >> np.uint32(15))) * np.uint32(0x9E3779B1))
        tail = signs[max(0, len(signs) - ORDERS + 1) :]
        total += np.bincount(np.concatenate(mixed) >> np.uint32(32 - BUCKET_BITS), minlength=len(total))
    if not lettered:
        return None
    buckets = np.flatnonzero(total)
    return buckets.astype(np.int32), total[buckets]


@dataclass
class Model:
    """Languages, idf and row of each bucket (row 0: no weight), weights by row, intercepts and temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    row: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        found = counts(text)
        return found and (found[0], scaled(found, self.idf))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.features(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax((found[1] @ self.weights[self.row[found[0]]] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def scaled(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    values = np.log1p(found[1]) * idf[found[0]]
    return values / math.sqrt(values @ values)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_regularised_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, language) and intercepts; z and n are the sums that FTRL-proximal keeps, weights follow from them."""
    z, n = (np.zeros(((1 << BUCKET_BITS) + 1, n_languages)) for _ in range(2))
    penalty = np.full(len(z), L1)
    penalty[-1] = 0.0  # the intercept

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1[:, None], 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(epochs):
        for buckets, values, language in rows:
            at, x = np.append(buckets, len(z) - 1), np.append(values, 0.1)
            z_at, n_at = z[at], n[at]
            w = weights(z_at, n_at, penalty[at])
            error = softmax(x @ w)
            error[language] -= 1
            g = x[:, None] * error
            squares = n_at + g * g
            z[at] = z_at + g - (np.sqrt(squares) - np.sqrt(n_at)) / ALPHA * w
            n[at] = squares
    w = weights(z, n, penalty)
    return w[:-1], 0.1 * w[-1]


def temperature(logits: np.ndarray, languages: np.ndarray) -> float:
    """What logits are divided by for the least log loss, found by a golden-section search over its logarithm.

    As in Platt's scaling a label counts as right but for one in n + 2, so that n rows without a fault do not make a score certain.
    """
    n, k = logits.shape
    targets = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    targets[np.arange(n), languages] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        return float(-(targets * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))).sum())

    low, high, ratio = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(rows: list[tuple[str, str]], idf: np.ndarray, languages: list[str]) -> Model:
    """Model from (text, language) rows: weights from four of five, temperature from the fifth."""
    found = [(counts(text), languages.index(lang)) for text, lang in rows]
    found = [(f[0], scaled(f, idf), k) for f, k in found if f]
    learned = [r for i, r in enumerate(found) if i % 5]
    if not learned:
        learned = found
    if not learned:
        return Model()
    w, bias = follow_the_regularised_leader(learned, len(languages))
    used = np.flatnonzero(np.any(w != 0, axis=1))
    row = np.zeros(len(w), np.int32)
    row[used] = np.arange(1, len(used) + 1)
    model = Model(languages, idf, row, np.vstack([np.zeros((1, len(languages))), w[used]]), bias)
    rest = found[::5]
    logits = np.array([values @ model.weights[row[buckets]] + bias for buckets, values, _ in rest])
    model.temperature = temperature(logits, np.array([k for _, _, k in rest]))
    return model


def remainder(id_col: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo the folds; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many of all texts have letters, and how many have an n-gram of each bucket: at most one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if found := counts(text.as_py()):
                    total[found[0]] += 1
                    total[-1] += 1
        buckets = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(total[buckets], pa.int64())], ["bucket", "n"])

    parts = small_batches(df).select(text_col).mapInArrow(run, "bucket int, n long")
    sums, total = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow(), np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    total[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return int(total[-1]), total[:-1]


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_labelled: int, max_bytes: int, max_languages: int) -> tuple[list[tuple[str, str]], list[str]]:
    """Bounded sample of (text, language) by a hash, in equal shares for each language, and the languages."""
    size = F.octet_length(text_col)
    sizes = df.groupBy(lang_col).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    sizes = sizes.orderBy(F.desc("n"), lang_col).limit(max_languages).collect()
    if not sizes:
        return [], []
    rows, share = max(1, max_labelled // len(sizes)), max_bytes // len(sizes)
    chance = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(min(1.0, rows / r["n"], share / max(1, r["bytes"]))))])
    drawn = F.pmod(F.xxhash64(F.lit("language"), id_col, text_col), F.lit(1 << 32))
    some = df.where(F.col(lang_col).isin([r[0] for r in sizes]) & (size <= share))
    some = some.where(drawn < F.element_at(chance, F.col(lang_col)) * float(1 << 32))
    some = some.select(text_col, lang_col, drawn.alias("drawn")).orderBy("drawn", text_col, lang_col).limit(2 * max_labelled)
    return [(r[0], r[1]) for r in some.collect()], sorted(r[0] for r in sizes)


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Model from the labelled documents outside the held-out fold."""
    known = df.where((remainder(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)
    rows, languages = sample(known, id_col, text_col, lang_col, max_labelled, max_bytes, max_languages)
    if not rows:
        return Model()
    n, frequencies = document_frequencies(known, text_col)
    return fit(rows, np.log((1 + n) / (1 + frequencies)) + 1, languages)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's id, held_out, lang_pred and score. Only texts go to Python."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = small_batches(df).select(id_col, (remainder(id_col) == 1).alias("held_out"), predicted(F.col(text_col)).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")
