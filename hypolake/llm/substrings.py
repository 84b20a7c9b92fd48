"""Substring dedup by seed and extend on winnowed anchors.

Seeds: the winnowing anchors of a text are the smallest hashes of runs of ``seed``
words in each window of ``length`` words, so two places that share ``length``
words share an anchor at the same offset. An anchor's span is all windows that
have it as their own anchor.

Join: occurrences of an anchor meet its earlier occurrences. One with the same
span meets the earliest of those; where an anchor has several spans, the earliest
occurrence of each goes on, and its windows meet the earliest of the same window.
So every occurrence has a partner for each of its repeated windows, a passage that
stands in n documents gives n rows an anchor and never n^2 pairs, and no group is
gathered in one task.

Extend: seeds of two documents that lie on one diagonal in a row become one match.
The words of its earlier place are fetched and compared with those of the later
place, to the left and to the right as far as they agree (at most ``length`` words
beyond the seeds: what lies further has seeds of its own). Agreeing stretches of
``length`` words or more are kept as maximal repeats, and the later place loses
its words. Hashes (64 bits for an anchor, 64 for a span, 95 for a window) choose
partners; what is removed is decided on words.

Defined cases: ids may have any type with an order; a null or empty text has no
words, and one shorter than ``length`` loses none; repeated rows (same id, same
text) are one document and come out once each; what only rows of one id share
stays (beyond repeats within one text); a null id comes before all others; an
empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolake.llm.common import passing, small_batches, written

LENGTH, SEED = 20, 6
#: Words of a document whose slices are fetched together.
BLOCK = 4096
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _rolling(words, width: int, base: int):
    """Hash of every run of ``width`` words."""
    import numpy as np

    out, power = np.zeros(len(words) - width + 1, np.uint64), 1
    for j in range(width):
        out += words[j : j + len(out)] * np.uint64(power)
        power = power * base & (1 << 64) - 1
    return _mixed(out)


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS: list = []


def _powers(n: int):
    """Powers of BASES[1] and of its inverse modulo 2^64, at least n of each; kept for texts of usual length."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, n)
        made = []
        for base in (BASES[1], pow(BASES[1], -1, 1 << 64)):
            factors = np.full(size, np.uint64(base))
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        if size > 1 << 20:
            return made
        _POWERS[:] = made
    return _POWERS


def word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def own_anchors(hashes, length: int, seed: int):
    """Hashes of the seeds, and the position of the anchor of every window."""
    import numpy as np

    seeds = _rolling(hashes, seed, BASES[0])
    view = np.lib.stride_tricks.sliding_window_view(seeds, length - seed + 1)
    return seeds, np.arange(len(view)) + view.argmin(axis=1)

def _anchors(length: int, seed: int):
    """The anchors of each text, once each as an occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for text in batch.column(0):
                words = text.as_py().encode().split()
                if len(words) >= length:
                    seeds, own = own_anchors(word_hashes(words), length, seed)
                    out.append(seeds[np.unique(own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["anchor"])

    return run


def _first_places(values):
    """For every value the index of its first occurrence."""
    import numpy as np

    _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    return first[inverse]


def _spans(length: int, seed: int):
    """For every anchor: its hash, its span's hash, first window and number of windows, and where the span begins in the text before (or -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows, cols = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column(2)):
                words = text.as_py().encode().split()
                if len(words) < length:
                    continue
                hashes = word_hashes(words)
                seeds, own = own_anchors(hashes, length, seed)
                at, lo, n = np.unique(own, return_index=True, return_counts=True)
                # hash of the span's words from prefix sums: sum of h[j] * B^j, times B^-lo
                powers = _powers(len(words))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[0][: len(words)], dtype=np.uint64)])
                span = (sums[lo + n - 1 + length] - sums[lo]) * powers[1][lo] + n.astype(np.uint64) * np.uint64(BASES[2])
                span = _mixed(span)
                first = _first_places(span)  # equal spans have equal anchors
                before = np.where(first < np.arange(len(at)), lo[first], -1)
                rows.append(np.full(len(at), i))
                for col, x in zip(cols, (seeds[at].view(np.int64), span.view(np.int64), lo.astype(np.int32), n.astype(np.int32), before.astype(np.int32))):
                    col.append(x)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.concatenate(c)) for c in cols)], ["kd", "th", "anchor", "words", "lo", "n", "before"])

    return run


def _windows(length: int):
    """Hashes of the single windows of spans, their starts, and where the window is in the document's spans before (or -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows, cols = [], [[], [], [], []]
            for i, (text, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                hashes = word_hashes(text.as_py().encode().split())
                lo, n = (spans.values.field(k).to_numpy() for k in (0, 1))
                s = np.unique(np.concatenate([np.arange(a, a + k) for a, k in zip(lo, n)]))
                one = _rolling(hashes, length, BASES[1])[s].view(np.int64)
                two = (_rolling(hashes, length, BASES[2])[s] >> np.uint64(33)).astype(np.int32)
                first = _first_places(one)
                before = np.where(first < np.arange(len(s)), s[first], -1)
                rows.append(np.full(len(s), i))
                for col, x in zip(cols, (one, two, s.astype(np.int32), before.astype(np.int32))):
                    col.append(x)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.concatenate(c)) for c in cols)], ["kd", "th", "w1", "w2", "lo", "before"])

    return run


def _slices(length: int):
    """Words of the wanted places of a document with up to ``length`` words on both sides, joined by blanks, and how many words stand in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows, starts, sizes, fronts, slices = [], [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3))):
                words = text.as_py().encode().split()
                for s, n in zip(*(wanted.values.field(k).to_pylist() for k in (0, 1))):
                    front = min(s, length)
                    rows.append(i)
                    starts.append(s)
                    sizes.append(n)
                    fronts.append(front)
                    slices.append(b" ".join(words[s - front : s + n + length - 1 + length]).decode())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(np.array(c, np.int32)) for c in (starts, sizes, fronts)), pa.array(slices, pa.string())], ["skd", "sth", "s", "n", "front", "slice"])

    return run


def extended(words: list[bytes], source: list[bytes], at: int, seeds: tuple[int, int], length: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least ``length`` words that agree with the source, whose first word lies opposite words[at] (at may be negative): what the seeds cover, extended to both sides."""
    lo, hi = max(0, at), min(len(words), at + len(source))
    start, end = seeds
    if words[start:end] == source[start - at : end - at]:
        while start > lo and words[start - 1] == source[start - 1 - at]:
            start -= 1
        while end < hi and words[end] == source[end - at]:
            end += 1
        return [(start, end)] if end - start >= length else []
    out, since = [], lo
    for p in range(lo, hi + 1):  # unequal words under equal hashes
        if p == hi or words[p] != source[p - at]:
            if p - since >= length:
                out.append((since, p))
            since = p + 1
    return out


def _rest(length: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            counts, removed, digests, spans = [], [], [], []
            for text, matches in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode().split()
                edges = np.zeros(len(words) + 1, np.int32)
                if matches.is_valid:
                    for t, n, front, piece in zip(*(matches.values.field(k) for k in range(4))):
                        t, n, front = t.as_py(), n.as_py(), front.as_py()
                        for a, b in extended(words, piece.as_py().encode().split(), t - front, (t, t + n + length - 1), length):
                            edges[a] += 1
                            edges[b] -= 1
                gone = np.cumsum(edges)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = hashlib.sha256()
                at, first = 0, True
                for a, b in [*zip(turns[::2].tolist(), turns[1::2].tolist()), (len(words), len(words))]:
                    if a > at:
                        kept.update((b"" if first else b" ") + b" ".join(words[at:a]))
                        first = False
                    at = b
                counts.append(len(words))
                removed.append(int(gone.sum()))
                digests.append(kept.hexdigest())
                spans.append([{"first_word": int(a), "n_words": int(b - a)} for a, b in zip(turns[::2], turns[1::2])])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((counts, removed, digests, spans), kinds))], [id_col, "n_words", "n_removed", "kept_sha256", "removed"])

    return run


def _partners(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, Column]:
    """rows with the first occurrence of their keys, whether that is in a smaller id, and whether the row has an earlier place of any kind."""
    joined = rows.join(firsts, keys)
    smaller = F.struct("first.kd") < F.struct("kd")
    return joined, smaller, smaller | (F.col("before") >= 0)


def _matches(joined: DataFrame, smaller: Column, later: Column, n: Column) -> DataFrame:
    """kd, th, lo, n and the earlier place skd, sth, slo."""
    source = lambda other, own: F.when(smaller, F.col(other)).otherwise(F.col(own))
    return joined.where(later).select("kd", "th", "lo", n.alias("n"), source("first.kd", "kd").alias("skd"), source("first.th", "th").alias("sth"), source("first.lo", "before").alias("slo"))


def _same(a: DataFrame, b: DataFrame, *pairs: tuple[str, str]) -> Column:
    """The join's condition, in which null ids are equal."""
    out = None
    for x, y in pairs:
        one = a[x].eqNullSafe(b[y]) if x in ("kd", "skd") else a[x] == b[y]
        out = one if out is None else out & one
    return out


def matches(base: DataFrame, kd: str, length: int = LENGTH, seed: int = SEED, written: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Joined seeds: windows lo to lo + n - 1 of a document (kd, th) that stand at slo in (skd, sth) before; base has kd, th, text. ``written`` keeps what is read more than once."""
    seed = min(seed, length)
    # aggregates are written before they are joined, so that a join of two plain exchanges is left, whose hot keys adaptive execution splits
    shared = written(base.select("text").mapInArrow(_anchors(length, seed), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    spans = base.select("kd", "th", "text").mapInArrow(_spans(length, seed), f"kd {kd}, th int, anchor long, words long, lo int, n int, before int")
    seeds = written(spans.join(shared, "anchor", "left_semi"))
    first = F.min(F.struct("kd", "th", "lo")).alias("first")
    whole = written(seeds.groupBy("anchor", "words").agg(first))
    several = whole.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor")
    placed, smaller, later = _partners(seeds, whole, ["anchor", "words"])
    found = _matches(placed, smaller, later, F.col("n"))
    ahead = placed.where(~later).join(several, "anchor", "left_semi").groupBy("kd", "th").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    asked = base.join(ahead, _same(base, ahead, ("kd", "kd"), ("th", "th"))).select(base["kd"], base["th"], "text", "spans")
    windows = written(asked.mapInArrow(_windows(length), f"kd {kd}, th int, w1 long, w2 int, lo int, before int"))
    single = written(windows.groupBy("w1", "w2").agg(first, F.count("*").alias("all")).where("all > 1").drop("all"))
    placed, smaller, later = _partners(windows, single, ["w1", "w2"])
    return found.unionByName(_matches(placed, smaller, later, F.lit(1)))


def in_rows(found: DataFrame) -> DataFrame:
    """Seeds that follow each other on one diagonal of two documents, as one."""
    diagonal = ["kd", "th", "skd", "sth", "_d"]
    by = Window.partitionBy(*diagonal).orderBy("lo", "n")
    reached = F.max(F.col("lo") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_d", F.col("lo") - F.col("slo")).withColumn("_new", F.coalesce((F.col("lo") > reached).cast("int"), F.lit(1)))
    rows = rows.withColumn("_row", F.sum("_new").over(by))
    merged = rows.groupBy(*diagonal, "_row").agg(F.min("lo").alias("t"), F.max(F.col("lo") + F.col("n")).alias("_end"))
    return merged.select("kd", "th", "t", (F.col("_end") - F.col("t")).alias("n"), "skd", "sth", (F.col("t") - F.col("_d")).alias("s"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row: n_words, n_removed (words in a window of ``length`` words that starts earlier, too), the digest of the other words joined by blanks, and the maximal repeats removed as spans of words."""
    kd = df.schema[id_col].dataType.simpleString()
    base = small_batches(df).select(F.col(id_col).alias("kd"), F.coalesce(text_col, F.lit("")).alias("text")).select("kd", F.hash("text").alias("th"), "text")
    with passing(df.sparkSession) as keep:  # seeds and windows, many times the rows, are not read again
        rows = written(in_rows(matches(base, kd, length, seed, keep)))
    wanted = rows.select("skd", "sth", "s", "n").distinct().groupBy("skd", "sth", F.floor(F.col("s") / BLOCK)).agg(F.collect_list(F.struct("s", "n")).alias("wanted")).select("skd", "sth", "wanted")
    places = base.join(wanted, _same(base, wanted, ("kd", "skd"), ("th", "sth"))).select("kd", "th", "text", "wanted")
    slices = written(places.mapInArrow(_slices(length), f"skd {kd}, sth int, s int, n int, front int, slice string"))
    met = rows.join(slices, _same(rows, slices, ("skd", "skd"), ("sth", "sth"), ("s", "s"), ("n", "n"))).select("kd", "th", F.struct("t", rows["n"], "front", "slice").alias("match"))
    gone = met.groupBy("kd", "th").agg(F.collect_list("match").alias("matches"))
    schema = f"`{id_col}` {kd}, n_words long, n_removed long, kept_sha256 string, removed array<struct<first_word:bigint,n_words:bigint>>"
    return base.join(gone, _same(base, gone, ("kd", "kd"), ("th", "th")), "left").select(base["kd"], "text", "matches").mapInArrow(_rest(length, id_col), schema)
