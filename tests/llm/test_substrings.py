import hashlib
import random
import time
from pathlib import Path

from helpers import documents, hard_rows, text

from hypolake.llm import common, substrings


def split(t):
    for c in "\t\n\x0b\x0c\r":
        t = (t or "").replace(c, " ")
    return [w for w in (t or "").split(" ") if w]


def slow(rows, length=20):
    docs = [(i, split(t)) for i, t in rows]
    first = {}
    for i, w in sorted(docs, key=lambda d: d[0]):
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), (i, s))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (i, s):
                gone.update(range(s, s + length))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r)[:4] for r in substrings.remove_repeats(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_against_brute_force(spark):
    rng = random.Random(13)
    passage, other = text(rng, 60), text(rng, 25)
    rows = [(i, f"{text(rng, rng.randint(0, 40))} {passage} {text(rng, 10)}") for i in range(10, 20)]
    rows += [(30, f"{passage} x {passage}"), (31, other), (32, other), (33, other + " y"), (34, passage[: len(passage) // 2]), (35, "a " * 90), (36, "b c " * 50), (37, text(rng, 400)), (38, text(rng, 19)), (39, None), (40, "")]
    assert run(spark, rows) == slow(rows)


def test_chains_of_overlapping_repeats(spark):
    """Windows that span two passages, each of another document, stay; those inside one go."""
    rng = random.Random(14)
    a, b = text(rng, 30), text(rng, 30)
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, f"{a} {b}"), (6, " ".join(f"{a} {b}".split()[10:45]))]
    assert run(spark, rows) == slow(rows)


def test_random_small_alphabet(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(60)]
    assert run(spark, rows) == slow(rows)


def test_hard_rows(spark):
    rows = [(i, t) for i, t in hard_rows(random.Random(16)) if i != 7 and i is not None]
    twice = rows + [(5, rows[5][1])]
    got = run(spark, twice)
    assert sorted(set(got)) == slow(rows) and len(got) == len(twice)
    out = substrings.remove_repeats(documents(spark, hard_rows(random.Random(16))))
    assert out.count() == 12 and out.where("doc_id is null").count() == 1
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_spans_are_maximal_repeats(spark):
    rng = random.Random(17)
    p = text(rng, 40)
    got = {r["doc_id"]: r["removed"] for r in substrings.remove_repeats(documents(spark, [(1, p), (2, f"q {p} r")])).collect()}
    assert got[1] == [] and [tuple(s) for s in got[2]] == [(1, 40)]


def test_spans_of_one_anchor_that_share_32_bits(spark):
    """Two texts of 20 words with one anchor, whose hashes agree in their upper half, are not repeats."""
    import numpy as np

    words = [f"w{i}" for i in range(19)]
    last = [f"x{i}" for i in range(400_000)]
    fixed = substrings.word_hashes([w.encode() for w in words])
    powers = substrings._powers(20)[0]
    made = substrings.word_hashes([w.encode() for w in last])
    total = (fixed * powers[:19]).sum(dtype=np.uint64) + made * powers[19] + np.uint64(substrings.BASES[2])
    half = substrings._mixed(total) >> np.uint64(32)
    order = np.argsort(half, kind="stable")
    at = np.flatnonzero(half[order][1:] == half[order][:-1])
    anchor = lambda w: substrings.own_anchors(substrings.word_hashes([x.encode() for x in w]), 20, 6)[1][0]
    pairs = [(words + [last[order[i]]], words + [last[order[i + 1]]]) for i in at]
    a, b = next((a, b) for a, b in pairs if anchor(a) == anchor(b) < 14)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b))]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_any_length_and_seed(spark):
    rng = random.Random(18)
    passage, many = text(rng, 130), text(rng, 70)
    rows = [(i, f"{text(rng, rng.randint(0, 30))} {passage if i % 2 else many} {text(rng, 9)}") for i in range(10)]
    rows += [(20, f"{passage} {passage}"), (21, "a b " * 70), (22, " ".join(rng.choice("ab") for _ in range(200))), (23, " ".join(many.split()[5:64])), (24, None)]
    for length in (5, 20, 22, 50):
        got = sorted(tuple(r)[:4] for r in substrings.remove_repeats(documents(spark, rows), length=length).collect())
        assert got == slow(rows, length), length


def test_ids_that_are_texts(spark):
    p = text(random.Random(19), 40)
    df = spark.createDataFrame([("b", p), ("a", f"x {p}"), (None, p[:-1] + "q"), ("b", p)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [("", 0), ("a", 39), ("b", 40), ("b", 40)]


def test_extension_decides_on_words():
    w = [b"w%d" % i for i in range(60)]
    assert substrings.extended(w, w[5:50], 5, (10, 30), 20) == [(5, 50)]
    other = w[5:30] + [b"x"] + w[31:50]
    assert substrings.extended(w, other, 5, (8, 40), 20) == [(5, 30)]
    assert substrings.extended(w, [b"x"] * 45, 5, (8, 40), 20) == []
    assert substrings.extended(w, [b"x", *w[:25]], -1, (0, 20), 20) == [(0, 25)]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_nothing_that_was_read_stays_on_disk(spark, monkeypatch):
    """Shuffles end with the tables they were made for; seeds and windows are gone when the result is asked for."""
    made = []
    whole = common.written_in_turn
    monkeypatch.setattr(common, "written_in_turn", lambda *a: made.append(whole(*a)) or made[-1])
    rng = random.Random(20)
    passage = text(rng, 50)
    rows = [(i, f"{text(rng, i % 5)} {passage} {text(rng, 9)}") for i in range(40)]
    before = shuffle_files(spark)
    out = substrings.remove_repeats(documents(spark, rows))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    gone = [not Path(t.inputFiles()[0].removeprefix("file:")).exists() if t.inputFiles() else True for t in made]
    assert len(gone) == 7 and all(gone[:5]) and not any(gone[5:])
    assert spark.conf.get(common.SHUFFLES_END) == "false"
    assert sorted(tuple(r)[:4] for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == slow(rows)
