import hashlib
import random
import re
import zlib

import numpy as np
from helpers import documents, hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from hypolake.llm import periodic


def brute_runs(words, min_words=6, min_exponent=4):
    """Every period, every stretch."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            smaller = any(all(words[j] == words[j + r] for j in range(start, start + length - r)) for r in range(1, q))
            if length >= max(min_words, min_exponent * q) and not smaller and i > start:
                out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def query(docs):
    return periodic.digests(periodic.with_runs(periodic.with_planted_runs(docs)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 9), st.integers(1, 6))
def test_runs_of_numbers(head, period, times):
    words = head + (head[-period:] or [0]) * times + head[:5]
    for min_words, min_exponent in ((6, 4), (1, 2), (3, 3)):
        assert periodic.runs_of(np.array(words, np.int32), min_words, min_exponent) == brute_runs(words, min_words, min_exponent)


def test_nested_and_neighbouring_runs():
    words = (["a"] * 6 + ["b"]) * 4 + ["b"] * 7 + ["c", "d"] * 4 + ["d"] * 5
    found, collapsed = periodic.search(" ".join(words))
    assert found == brute_runs(words) and {q for _, _, q in found} == {1, 2, 7}
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    assert collapsed.split() == [w for i, w in enumerate(words) if i not in gone]


def test_long_texts():
    rng = random.Random(5)
    period = [rng.choice("abcde") for _ in range(97)]
    for words in (["x"] * 150_000, period * 1500, [str(i % 30_000) for i in range(130_000)]):
        found, collapsed = periodic.search(" ".join(words))
        n, q = len(words), found[0][2]
        assert max(found, key=lambda r: r[1])[1] == n and all(words[i] == words[i + q] for i in range(n - q))
        assert collapsed.split() == words[:q]


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(9)
    made = []
    for i in range(1000, 1200):
        words = [rng.choice("ab") for _ in range(rng.randint(1, 70))]
        made.append((i, " ".join(words)))
    short = docs.where("length(text) < 1000").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in short] + made
    want = sorted((brute_row(*r) for r in rows), key=str)
    assert rows_of(query(documents(spark, rows))) == want
    assert any(r[1] for r in want)


def test_hard_rows(spark):
    rows = hard_rows(random.Random(6)) + [(i, "x y " * 9) for i in (50, 50, 51)]
    got = query(documents(spark, rows))
    small = [r for r in rows if r[0] not in (5, 6)]
    assert rows_of(query(documents(spark, small))) == sorted((brute_row(*r) for r in small), key=str)
    assert got.count() == len(rows) and query(documents(spark, [])).count() == 0


def test_other_columns_stay(spark):
    docs = documents(spark, [(1, "a b " * 5)]).withColumnRenamed("copies", "runs").withColumnRenamed("w", "collapsed")
    row = periodic.with_runs(docs).first()
    assert row["collapsed"] == "a b" and [tuple(r) for r in row["runs"]] == [(0, 10, 2)] and row["component_id"] == 2
