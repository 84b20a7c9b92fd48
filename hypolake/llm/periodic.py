"""Periodic run detection over the words of texts.

Words are runs of anything but ASCII white space. A run is a stretch of consecutive words with smallest
period q (words q apart are the same) that no neighbouring word extends keeping q, of at least ``min_words``
words and ``min_exponent`` periods. Each text is searched by itself, in the task that holds it:

* a run says each of its words ``min_exponent`` times at least, so rarer words belong to no run and part the
  text into stretches that are searched one by one;
* a suffix automaton of a stretch is built; its states are visited from the longest down, and the end
  positions of a state are merged into those of its suffix link, the smaller set into the larger one. Two
  positions that become neighbours there, not further apart than the state is long, end two copies of a
  string that touch or overlap: a square, which seeds a run;
* a seed is extended both ways, unless it lies in a stretch that is known for its period.

No run is missed: its first length - q words recur q words later and nowhere in between, so their two
end positions become neighbours in the state where they meet, which is at least q long.

A text needs some 100 bytes a word of its longest stretch beside itself, as states keep numbers in flat arrays,
and time that grows with n log n.

Defined cases: a null or empty text has no words and no runs, and collapses to an empty text; texts are taken
whole, whatever their length; repeated rows and rows without ids are searched like any other; an empty table
gives an empty result; other columns are carried along, and a column with the name of a result gives way to it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_WORDS, MIN_EXPONENT = 6, 4


class Ends:
    """An ordered set of end positions, in blocks that are split when they are full."""

    __slots__ = ("blocks", "firsts", "size")
    FULL = 1024

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [array("i", (first,))], [first], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, p: int) -> tuple[int, int]:
        """Puts p in and gives its neighbours (-1: none); p is not in the set yet."""
        b = max(0, bisect_right(self.firsts, p) - 1)
        block = self.blocks[b]
        i = bisect_left(block, p)
        before = block[i - 1] if i else (self.blocks[b - 1][-1] if b else -1)
        after = block[i] if i < len(block) else (self.firsts[b + 1] if b + 1 < len(self.blocks) else -1)
        block.insert(i, p)
        self.size += 1
        if not i:
            self.firsts[b] = p
        if len(block) > self.FULL:
            half = len(block) // 2
            self.blocks.insert(b + 1, block[half:])
            self.firsts.insert(b + 1, block[half])
            del block[half:]
        return before, after


class Automaton:
    """Suffix automaton of a list of numbers. Most states have one way on, kept in two flat arrays; others have a dict."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.end = array("i", (0,)), array("i", (-1,)), array("i", (-1,))
        self.word, self.target, self.more = array("i", (-1,)), array("i", (-1,)), {}
        last = 0
        for place, c in enumerate(words):
            last = self._extend(last, c, place)

    def _state(self, length: int, link: int, end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        self.word.append(-1)
        self.target.append(-1)
        return len(self.length) - 1

    def _on(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.target[state]
        return self.more[state].get(c, -1) if state in self.more else -1

    def _set(self, state: int, c: int, target: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.target[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _extend(self, last: int, c: int, place: int) -> int:
        new, p = self._state(self.length[last] + 1, 0, place), last
        while p >= 0 and (q := self._on(p, c)) < 0:
            self._set(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.length[p] + 1, self.link[q], -1)
        self.word[copy], self.target[copy] = self.word[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p >= 0 and self._on(p, c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def seeds(self) -> Iterator[tuple[int, int, int]]:
        """(distance, later end, length) of the squares that merging end positions brings together."""
        length, link, end = self.length, self.link, self.end
        self.more = self.word = self.target = None  # ways are not needed any more
        sets: dict[int, Ends] = {}
        for state in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist():
            parent = link[state]
            if parent <= 0:  # the empty string ends everywhere, but is no seed
                sets.pop(state, None)
                continue
            mine = sets.pop(state, None) or Ends(end[state])
            theirs = sets.get(parent)
            if theirs is None:
                if end[parent] < 0:
                    sets[parent] = mine
                    continue
                theirs = Ends(end[parent])
            small, large = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
            size = length[parent]
            for p in small:
                before, after = large.add(p)
                if before >= 0 and p - before <= size:
                    yield p - before, p, size
                if after >= 0 and after - p <= size:
                    yield after - p, after, size
            sets[parent] = large


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Leading entries that are the same, looked at in pieces of growing size."""
    n, at, piece = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : at + piece] != b[at : at + piece][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, piece = min(n, at + piece), piece * 2
    return n


def _is_smallest(words: np.ndarray, period: int) -> bool:
    """Whether no divisor of a period of the words is a period as well."""
    left, divisors, r = period, set(), 2
    while r * r <= left:
        if left % r:
            r += 1
        else:
            divisors.add(r)
            left //= r
    if left > 1:
        divisors.add(left)
    return not any(np.array_equal(words[: -(period // r)], words[period // r :]) for r in divisors)


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a stretch of numbered words, in order of start and period."""
    known: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    found = []
    for d, end, size in Automaton(words.tolist()).seeds():
        starts, ends = known[d]
        at = bisect_right(starts, end - d)
        if at and ends[at - 1] >= end:
            continue
        first = end - d - size + 1
        first -= _same(words[:first][::-1], words[: first + d][::-1])
        last = end + _same(words[end + 1 :], words[end + 1 - d :])
        starts.insert(at, first)
        ends.insert(at, last)
        n = last - first + 1
        if n >= max(min_words, min_exponent * d) and _is_smallest(words[first : last + 1], d):
            found.append((first, n, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def search(text: str | None, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> tuple[list[tuple[int, int, int]], str]:
    """Runs of a text, and the text without what runs repeat: words of a run after its first period go."""
    numbers: dict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = np.fromiter((numbers[m.group()] for m in WORD.finditer(text or "")), np.int32)
    often = np.zeros(len(words) + 2, np.int8)
    often[1:-1] = np.bincount(words, minlength=1)[words] >= min_exponent
    edges = np.flatnonzero(np.diff(often))
    found, gone = [], np.zeros(len(words) + 1, np.int64)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= min_words:
            found += [(a + s, n, q) for s, n, q in runs_of(words[a:b], min_words, min_exponent)]
    for s, n, q in found:
        gone[s + q] += 1
        gone[s + n] -= 1
    kept = words[np.cumsum(gone[:-1]) == 0]
    spelled = list(numbers)
    return found, " ".join([spelled[i] for i in kept.tolist()])


def with_runs(df: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """df with runs (array of start, length, period) and collapsed (the text without repeated periods)."""

    @F.pandas_udf("start array<long>, length array<long>, period array<long>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                runs, collapsed = search(text, min_words, min_exponent)
                rows.append(([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], collapsed))
            yield pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"])

    rest = [c for c in df.columns if c.lower() not in ("runs", "collapsed")]
    out = small_batches(df).withColumn("__found", found(F.col(text_col)))
    runs = F.arrays_zip("__found.start", "__found.length", "__found.period")
    return out.select(*[F.col(f"`{c}`") for c in rest], runs.alias("runs"), F.col("__found.collapsed").alias("collapsed"))


def longest(runs: Column) -> Column:
    """The run of greatest length, ties to the smallest start, then period; null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["l"]).alias("length"), best["period"].alias("period")))


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with a tenth of its texts made periodic: of those whose h = crc32(id as text) is divisible by 10, the words from a on repeat the p words at a.

    With g = floor(h / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h, g = F.crc32(F.col(id_col).cast("string").cast("binary")), F.floor(F.col("__h") / 10)
    words = F.when((F.col("__h") % 10 == 0) & (F.col(text_col) != ""), F.regexp_extract_all(text_col, F.lit(WORD.pattern), F.lit(0)))
    n, a, p = F.size("__w"), F.col("__a"), F.col("__p")
    rest = F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.concat(F.slice("__w", F.lit(1), a), F.slice(rest, F.lit(1), n - a)), " ")
    steps = df.withColumn("__h", h).withColumn("__w", words)
    steps = steps.withColumn("__a", F.when(n > 0, g % n).cast("int"))
    steps = steps.withColumn("__p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    text = F.when(a.isNotNull(), periodic).otherwise(F.col(text_col)).alias(text_col)
    return steps.select(*[text if c == text_col else F.col(f"`{c}`") for c in df.columns])


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of with_runs: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = longest(F.col("runs"))
    part = lambda name: best[name].alias(name)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    milli = F.expr("1000 * best.length div best.period")
    out = df.withColumn("best", best)
    return out.select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], milli.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
