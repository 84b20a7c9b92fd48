import math
import random
import re

from helpers import documents, hard_rows, text

from hypolake.llm import quality


def slow(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            again.update(p + j for p in places for j in range(8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def junk(rng, kind):
    if kind == 0:
        return " ".join(w + "###" for w in text(rng, 60).split())
    if kind == 1:
        return (text(rng, 12) + " ") * 6
    return (text(rng, 30).upper() + "!!\n") * 3


def test_base_against_brute_force(spark):
    rng = random.Random(20)
    rows = hard_rows(rng) + [(20, "a b c d e f g h " * 5), (21, "x\nx\n\n \nx\ny\r\ny\r"), (22, text(rng, 30) + " " + text(rng, 7)), (23, (text(rng, 9) + ". ") * 3 + text(rng, 80)), (24, "#*$%&|<> " * 30), (25, "a " * 27)]
    got = sorted((tuple(r) for r in quality.judged(documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    assert got == sorted(((i, *slow(t)) for i, t in rows), key=repr)


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(21)
    clean = [(i, ". ".join(text(rng, 9) for _ in range(12)) + ".") for i in range(300)]
    bad = [(1000 + i, junk(rng, i % 3)) for i in range(60)]
    got = {r["doc_id"]: r for r in quality.judged(documents(spark, clean + bad)).collect()}
    assert all(got[i]["kept"] for i, _ in clean)
    assert not any(got[i]["kept"] for i, _ in bad)
    assert all(0 <= r["posterior"] <= 1 for r in got.values())


def test_empty_and_uniform_tables(spark):
    assert quality.judged(documents(spark, [])).count() == 0
    rng = random.Random(22)
    one = quality.judged(documents(spark, [(i, ". ".join(text(rng, 9) for _ in range(9)) + ".") for i in range(5)]))
    assert one.where("kept").count() == 5


def test_em_is_order_free_and_finite():
    counts = [((1, 0), 90), ((0, -1), 8), ((-1, -1), 2)]
    a, b = quality.fit(counts), quality.fit(counts[::-1])
    assert abs(a[0] - b[0]) < 1e-9 and 0 < a[0] < 1
    assert quality.fit([])[1] == []


def sample_votes(rng, n=3000):
    """Votes of six rules on documents of three kinds: good, symbol junk (rules 0 to 2) and repetition (rules 3 to 5)."""
    rows = []
    for _ in range(n):
        kind = rng.choices((0, 1, 2), (80, 12, 8))[0]
        wrong = lambda r: kind and r // 3 == kind - 1
        rows.append((kind, tuple((-1 if rng.random() < (0.9 if wrong(r) else 0.02) else rng.choice((1, 1, 1, 0))) for r in range(6))))
    return rows


def test_accuracies_are_estimated_and_one_bad_vote_is_outvoted():
    from collections import Counter

    rows = sample_votes(random.Random(23))
    found = quality.fit(list(Counter(v for _, v in rows).items()))
    share = sum(k == 0 for k, _ in rows) / len(rows)
    assert abs(found.share - share) < 0.02
    for r in range(6):
        for k, bad in enumerate((False, True)):
            told = [v[r] == -1 for kind, v in rows if bool(kind) == bad]
            assert abs(found.accuracies[r][-1][k] - sum(told) / len(told)) < 0.03
        assert all(abs(sum(t[v] for v in (-1, 0, 1)) - 1) < 1e-9 for t in [c[r] for c in found.tables])

    def good(votes):
        w = [p * math.prod(t[r][x] for r, x in enumerate(votes)) for p, t in zip(found.priors, found.tables)]
        return w[0] / sum(w)

    assert good((-1, 1, 1, 1, 1, 1)) > 0.5 > good((-1, -1, 1, 1, 1, 1))
    right = [(good(v) >= 0.5) == (kind == 0) for kind, v in rows]
    every = [(-1 not in v) == (kind == 0) for kind, v in rows]
    assert sum(right) / len(right) > 0.98 and sum(right) > sum(every)


def test_a_round_of_em_against_brute_force():
    """One round over counts equals one over documents, vote by vote."""
    import numpy as np

    rng = random.Random(24)
    docs = [tuple(rng.choice((-1, 0, 1)) for _ in range(4)) for _ in range(200)]
    unique = sorted(set(docs))
    start = {p: np.array(w) / sum(w) for p in unique for w in [[rng.random() + 0.1 for _ in range(3)]]}
    priors, tables = quality.maximise(np.array(unique), np.array([float(docs.count(p)) for p in unique]), np.array([start[p] for p in unique]))
    weights, _ = quality.expect(np.array(unique), priors, tables)
    for k in range(3):
        mass = sum(start[d][k] for d in docs)
        assert abs(priors[k] - (mass + 1) / (len(docs) + 3)) < 1e-12
        for r in range(4):
            for j, v in enumerate((-1, 0, 1)):
                more = quality.EVEN + quality.RIGHT * (v == (1 if k == 0 else -1))
                want = (sum(start[d][k] for d in docs if d[r] == v) + more) / (mass + 3 * quality.EVEN + quality.RIGHT)
                assert abs(tables[k, r, j] - want) < 1e-12
    for i, p in enumerate(unique):
        joint = [priors[k] * math.prod(tables[k, r, p[r] + 1] for r in range(4)) for k in range(3)]
        assert np.allclose(weights[i], np.array(joint) / sum(joint))


def test_verdicts_follow_the_posterior(spark, data):
    got = quality.judged(spark.read.parquet(f"{data}/documents.parquet")).collect()
    names = [f"vote_{k}" for k in quality.votes()]
    from collections import Counter

    found = quality.fit(list(Counter(tuple(r[n] for n in names) for r in got).items()))
    for r in got:
        w = [p * math.prod(t[j][r[n]] for j, n in enumerate(names)) for p, t in zip(found.priors, found.tables)]
        assert abs(r["posterior"] - w[0] / sum(w)) < 1e-6
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
