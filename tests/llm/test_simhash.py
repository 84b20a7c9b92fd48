import random
import uuid

import pytest
import xxhash
from helpers import documents, hard_rows, text
from pyspark.sql import functions as F

from hypolake.llm import common, simhash


def slow_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def slow_fingerprint(t):
    words = slow_words(t)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_sets(t, width=5):
    words = slow_words(t)
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / max(len(a | b), 1)


def slow_components(fps, bits=3, sets=None):
    """smallest id reachable, for (id, fp) rows; with sets, also over links of sets of a Jaccard similarity of 0.8 or more."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j, (_, b) in enumerate(fps[:i]):
            if bin(a ^ b).count("1") <= bits or (sets and jaccard(sets[i], sets[j]) >= 0.8):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, a, least.get(find(i))) for i, (k, a) in enumerate(fps) if k is not None)


def test_hash_is_sparks(spark):
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_rows_against_brute_force(spark):
    rng = random.Random(1)
    base = [text(rng, 40) for _ in range(10)]
    near = [(100 + i, b + " " + text(rng, 1)) for i, b in enumerate(base * 4)]
    rows = hard_rows(rng) + near + [(500, near[0][1].upper()), (501, base[0])]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got if r["doc_id"] is not None) == slow_components(fps)
    assert len(got) == len(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_every_bucket_size(spark):
    """A dense cluster, pairs at distance 3 and 4 across block borders, through each of the three ways."""
    rng = random.Random(2)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        fps.add(f)
        for d in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    center = rng.getrandbits(64)
    for _ in range(60):
        g = center
        for b in rng.sample(range(20), rng.randint(0, 4)):
            g ^= 1 << b
        fps.add(g)
    rows = [(signed(f), f) for f in sorted(fps)]
    df = spark.createDataFrame([(i,) for i, _ in rows], "fp long")
    for small, large, bits in ((48, 4096, 3), (2, 4096, 3), (2, 2, 3), (2, 2, 2), (2, 2, 1)):
        want = slow_components(rows, bits)
        nodes = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, bits, small=small, large=large)).collect()}
        least = {}
        for i, _ in rows:
            least.setdefault(nodes.get(i, i), []).append(i)
        assert sorted((i, i % (1 << 64), min(least[nodes.get(i, i)])) for i, _ in rows) == want


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(3)
    a = text(rng, 60)
    b, c = text(rng, 60), text(rng, 60)
    out = simhash.deduplicated(documents(spark, [(1, a), (1, a), (2, a), (2, a), (3, b), (3, c), (3, c), (None, text(rng, 60)), (None, text(rng, 60)), (None, a)]))
    ids = sorted((r["doc_id"] or -1 for r in out.collect()))
    assert ids == [-1, -1, 1, 3, 3] and out.columns == documents(spark, []).columns


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def edited(rng, words, level):
    """The words with single ones replaced for as long as the similarity stays at the level or above."""
    out, sets = list(words), slow_sets(" ".join(words))
    while True:
        more = list(out)
        more[rng.randrange(len(more))] = f"new{rng.randrange(10**6)}"
        if jaccard(sets, slow_sets(" ".join(more))) < level:
            return out
        out = more


def test_recall_of_planted_copies(spark):
    """At least nine of ten copies at each similarity are found, and texts below 0.8 stay apart."""
    rng = random.Random(60)
    names = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for level in (0.8, 0.9, 0.95, 0.7):
        for _ in range(40):
            words = [rng.choice(names) for _ in range(rng.choice([120, 400]))]
            other = edited(rng, words, level)
            pairs.append((len(rows), level, jaccard(slow_sets(" ".join(words)), slow_sets(" ".join(other)))))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    top = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(documents(spark, rows)).collect()}
    for level in (0.8, 0.9, 0.95):
        found = [top[i] == top[i + 1] for i, at, _ in pairs if at == level]
        assert sum(found) >= 0.9 * len(found), level
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert not any(top[i] == top[i + 1] for i, _, real in pairs if real < 0.8 and bin(fps[i] ^ fps[i + 1]).count("1") > 3)


def test_groups_larger_than_a_bucket_that_is_compared_whole(spark):
    """Near copies of a few texts, many more than FEW of each, against all pairs."""
    rng = random.Random(61)
    names = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(4):
        words = [rng.choice(names) for _ in range(150)]
        rows += [(len(rows) + k, " ".join(edited(rng, words, 0.9))) for k in range(60)]
    got = simhash.similar_documents(documents(spark, rows)).collect()
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows], sets=[slow_sets(t) for _, t in rows])
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, top) for i, _, top in want]


def test_wide_rule_on_the_tables(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.similar_documents(spark.read.parquet(f"{data}/documents.parquet")).collect()
    want = slow_components([(i, slow_fingerprint(t)) for i, t in rows], sets=[slow_sets(t) for _, t in rows])
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, top) for i, _, top in want]


def test_wide_rule_takes_hard_rows(spark):
    hard = documents(spark, hard_rows(random.Random(62)))
    assert simhash.similar_documents(hard).count() == hard.count()
    assert simhash.deduplicated(documents(spark, [])).count() == 0


@pytest.mark.parametrize("piece", [1024, 3])
def test_large_buckets_lose_no_similar_pair(spark, monkeypatch, piece):
    """Twelve sets in one bucket, two and two alike: no set alone meets all partners."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    rows = [(i, i, 20, [7], [100 * (i // 2) + j for j in range(19)] + [10_000 + i]) for i in range(12)]
    docs = spark.createDataFrame(rows, "cls long, fp long, n int, bands array<long>, marks array<int>")
    nodes = spark.createDataFrame([], "node long, root long")
    got = {tuple(sorted((r["u"], r["v"]))) for r in simhash.similar(docs, nodes, 0.8).collect()}
    assert got == {(i, i + 1) for i in range(0, 12, 2)}


def near_copies(rng, n):
    """Sets of marks, most a few marks off one of two middles, some of them sharing what they have beyond it, all in one bucket; and a count of pairs that are similar."""
    bases = [list(range(k * 1000, k * 1000 + 100)) for k in (0, 1)]
    extra = [rng.sample(range(100_000, 200_000), 12) for _ in range(6)]
    sets = {}
    for i in range(n):
        marks = set(bases[i % 8 == 0])
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            at = rng.randrange(96)
            marks -= set(sorted(marks)[at : at + 4])
            marks |= set(rng.sample(range(1_000_000, 1_000_000_000), 4))
        if i % 5 == 0:
            marks |= set(rng.choice(extra))
        sets[i] = marks
    return sets


@pytest.mark.parametrize("piece", [1024, 3])
def test_near_copies_of_one_bucket_make_few_pairs(spark, monkeypatch, piece):
    """Same components as all pairs make, without comparing a square of the bucket's sets."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    sets = near_copies(random.Random(63), 240)
    docs = spark.createDataFrame([(i, i, len(m), [7], sorted(m)) for i, m in sets.items()], "cls long, fp long, n int, bands array<long>, marks array<int>").cache()
    asked = []
    whole = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda d, pairs, s: asked.append(pairs.count()) or whole(d, pairs, s))
    got = [(r["u"], r["v"]) for r in simhash.similar(docs, spark.createDataFrame([], "node long, root long"), 0.8).collect()]
    assert all(jaccard(sets[u], sets[v]) >= 0.8 for u, v in got)
    parent = {True: {i: i for i in sets}, False: {i: i for i in sets}}

    def find(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for u, v in got:
        parent[True][find(parent[True], u)] = find(parent[True], v)
    for u in sets:
        for v in range(u):
            if jaccard(sets[u], sets[v]) >= 0.8:
                parent[False][find(parent[False], u)] = find(parent[False], v)
    groups = [{frozenset(j for j in sets if find(p, j) == find(p, i)) for i in sets} for p in parent.values()]
    assert groups[0] == groups[1] and 2 < len(groups[0]) < 200
    assert sum(asked) < 240 * 239 / 2 / 4


def test_tables_and_shuffles_end_with_what_reads_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "_folder", lambda s: str(tmp_path / uuid.uuid4().hex))
    cuts = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "checkpoint", lambda df, eager=True, f=frame.checkpoint: cuts.append(df) or f(df, eager))
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 380 + i] + [f"x{i}"])) for i in range(20)] + [(99, "another text of a few words")]
    named = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r["component_id"] for r in named.collect()}) == 2
    # a checkpoint's shuffles would stay until the driver collects garbage; sets of shingles and steps of components would stay to the end
    assert not cuts
    left = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
    assert ["doc_id", "component_id", "text_hash"] in left
    assert not any({"marks", "bands", "key", "cx", "m"} & set(c) for c in left)
