"""SimHash near-dedup with pigeonhole blocks.

A fingerprint is cut into six blocks. Two fingerprints that differ in at most
three bits share at least three whole blocks, so all close pairs meet under one
of the twenty choices of three blocks (a key of 32 bits or so, narrow enough to
stay selective at billions of fingerprints). Pairs are verified by their Hamming
distance. Only different fingerprints are compared; copies share one.

Buckets come in three sizes, each exact:
* up to SMALL fingerprints: the pairs of the bucket, verified in the join;
* up to LARGE: one task compares the bucket and gives a spanning forest;
* beyond: every member is written under all fingerprints at distance 0 to 2; two
  members are close exactly if one stands at distance <= 1 and the other at <= 2
  of a common variant, so a star at each variant keeps all links. The work is
  linear in the members and no bucket is gathered anywhere.

Components come from alternating large-star and small-star steps on the links of
fingerprints, each step written to a table. Tables of steps are deleted as soon as
nothing reads them; what is written does not make empty files or tasks, and its
shuffles end with it.

Fingerprints of 64 bits cannot tell texts at a similarity of 0.8 from others: such
pairs differ in some ten bits. ``deduplicated`` therefore adds to the links of
fingerprints those of a wide rule: shingles of five words, candidates by bands of
MinHash values, verified by the Jaccard similarity of the whole sets.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; fewer words than a shingle count as one shingle;
repeated rows come out once each; a null id never names a component unless all
ids of the component are null; an empty table gives an empty result; columns
other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import passing, small_batches, written

SHINGLE, MAX_BITS, BLOCKS, SMALL, LARGE = 3, 3, 6, 48, 4096
#: Of the wide rule: words of a shingle, similarity, MinHash bands and values in each (a pair at 0.8 shares a band with probability 0.998), sets of a bucket that are all compared at once, and of a piece of a larger one.
WIDE, SIMILARITY, BANDS, ROWS, FEW, PIECE = 5, 0.8, 16, 5, 8, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: a bit is set if it is set in over half the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    counts, step = np.zeros(64, np.int64), 1 << 14
    n = len(words) - shingle + 1
    for at in range(0, n, step):
        some = words[at : at + step + shingle - 1]
        runs = zip(*(some[i:] for i in range(shingle)))
        hashes = np.array([xxh64_intdigest(b" ".join(r), seed) for r in runs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(counts[i]) > n)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64()), batch.column(2)], ["id", "fp", "text_hash"])

    return small_batches(df).select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, fp long, text_hash long")


def block_masks() -> list[int]:
    """One mask of 64 bits, as a signed number, for each choice of three of the six blocks."""
    bounds = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    masks = [x | y | z for x, y, z in combinations(blocks, BLOCKS - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(max_bits: int):
    """Links of a spanning forest of the fingerprints in one bucket."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        todo, out = np.arange(len(fps)), []
        while len(todo):
            seen, front = np.zeros(len(fps), bool), [todo[0]]
            seen[todo[0]] = True
            while front:
                at = front.pop()
                near = todo[(np.bitwise_count(fps[todo] ^ fps[at]) <= max_bits) & ~seen[todo]]
                seen[near] = True
                out += [(fps[at], fps[j]) for j in near]
                front += list(near)
            todo = todo[~seen[todo]]
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def _variants(hot: DataFrame, max_bits: int) -> DataFrame:
    """Links of members of oversized buckets, by stars at common variants: of two close members one is within ``inner`` bits of some variant and the other within ``outer``, and such two are never further apart than max_bits."""
    inner = max_bits // 2
    outer = max_bits - inner
    masks = [sum(1 << b for b in bits) for n in range(outer + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = hot.select("fp", F.explode(F.array(*[F.lit(m) for m in signed])).alias("m")).select((F.col("fp").bitwiseXOR(F.col("m"))).alias("z"), "fp", (F.bit_count("m") <= inner).alias("near"))
    stars = rows.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("u"), F.count("*").alias("n")).where("n > 1 and u is not null").select("z", "u")
    return rows.join(stars, "z").where("u != fp").select("u", F.col("fp").alias("v"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """u < v: links that connect exactly the fingerprints (column fp, distinct) which pairs of at most max_bits (up to MAX_BITS) differing bits connect. No link is between fingerprints further apart."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the blocks find pairs of at most {MAX_BITS} differing bits")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks()])).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    with passing(fps.sparkSession) as keep:
        sizes = keep(sizes)
        pairs = sizes.where("n = 2").where(close("u", "v")).select("u", "v")
        members = keep(keyed.join(sizes.where("n > 2").select("choice", "key", "n"), ["choice", "key"]))
        few = members.where(F.col("n") <= small)
        a, b = few.select("choice", "key", F.col("fp").alias("u")), few.select("choice", "key", F.col("fp").alias("v"))
        in_few = a.join(b, ["choice", "key"]).where((F.col("u") < F.col("v")) & close("u", "v")).select("u", "v")
        in_some = members.where((F.col("n") > small) & (F.col("n") <= large)).groupBy("choice", "key").applyInPandas(_forest(max_bits), "u long, v long")
        in_many = _variants(members.where(F.col("n") > large).select("fp").distinct(), max_bits)
        found = pairs.unionByName(in_few).unionByName(in_some).unionByName(in_many)
        return written(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def components(edges: DataFrame, max_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """node and root (the component's smallest node) for every node of the links u, v, as a table that ``keep`` writes."""
    with passing(edges.sparkSession) as step:
        small = step(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct())
        before = None
        for _ in range(max_rounds):
            both = small.union(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")  # with copies, which end below
            roots = large.groupBy("v").agg(F.min("u").alias("m"))
            small = large.join(roots, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u != v").distinct()
            small = step(small)
            after = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if after == before or not after[0]:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
        return keep(small.select(F.col("v").alias("node"), F.col("u").alias("root")).union(small.select("u", "u").distinct()))


def _mixed(x):
    """64-bit numbers, their bits spread (numpy wraps around)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: str | None, shingle: int, bands: int = BANDS, rows: int = ROWS):
    """Keys of MinHash bands and the set of shingle marks (distinct, 32 bits each) of one text; none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    hashes, width = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), min(shingle, len(words))
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        runs = _mixed(runs + hashes[i : i + len(runs)] + np.uint64(i + 1))
    runs = np.unique(runs)
    factors = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least, step = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64), 1 << 12
    for at in range(0, len(runs), step):
        least = np.minimum(least, (runs[at : at + step, None] * factors).min(axis=0))
    keys = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = _mixed(keys + column)
    keys = _mixed(keys + np.arange(bands, dtype=np.uint64))  # the number of the band is part of its key
    return keys.view(np.int64), np.unique((runs >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, wide: int) -> DataFrame:
    """fingerprints() and, of the wide shingles, cls (a hash of the marks), n (their number), bands and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        for batch in batches:
            # a few texts at once, so that what is handed over stays small
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                texts = some.column(1).to_pylist()
                made = [sketch(t, wide) for t in texts]
                fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                cls = np.array([xxh64_intdigest(m.tobytes(), 7) for _, m in made], dtype=np.uint64).view(np.int64)
                columns = [some.column(0), pa.array(fps), some.column(2), pa.array(cls), pa.array([len(m) for _, m in made], pa.int32()), pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([m for _, m in made], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "text_hash", "cls", "n", "bands", "marks"])

    schema = f"id {df.schema[id_col].dataType.simpleString()}, fp long, text_hash long, cls long, n int, bands array<long>, marks array<int>"
    return small_batches(df).select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, schema)


def similar(docs: DataFrame, nodes: DataFrame, similarity: float, few: int = FEW) -> DataFrame:
    """u, v: fingerprints of texts whose sets of shingles have at least the given Jaccard similarity, among texts that share a band of MinHash values and are not yet of one component (nodes).

    Texts with the same set of shingles take part once. In a bucket of up to ``few`` sets all pairs are compared. In a larger one every set is
    first compared with one of the bucket, another one in each of the bands, which joins near copies in work linear in the members. Where several
    components are left, every set is compared with the middle of its bucket (see _middles), and then with those of other components that what is
    known of both does not rule out (see _open_pairs). Sets decide, all of them whole.
    """
    with passing(docs.sparkSession) as keep:
        one = docs.where("n > 0").select("cls", "fp", "n", "bands").dropDuplicates(["cls"])
        rooted = one.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left")
        keyed = rooted.select("cls", "n", F.coalesce("root", "fp").alias("root"), F.explode("bands").alias("key"))
        buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("a"), F.max("root").alias("z")).where("size > 1 and a != z").select("key", "size")
        members = keep(keyed.join(buckets, "key").select("key", "size", F.struct("cls", "n", "root").alias("m")))
        small, large = members.where(F.col("size") <= few).select("key", "m"), members.where(F.col("size") > few).select("key", "m")
        pairs = small.select("key", F.col("m").alias("x")).join(small.select("key", F.col("m").alias("y")), "key").where("x.cls < y.cls").select("x", "y")
        centres = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("m.cls", "key").alias("o"), "m")).getField("m").alias("c"))
        pairs = pairs.unionByName(large.join(centres, "key").select(F.least("m", "c").alias("x"), F.greatest("m", "c").alias("y")))
        found = _verified(docs, pairs, similarity)
        if large.isEmpty():
            return found.select("u", "v")
        # the components that these links leave; only buckets with several go on
        left = keep(_several(_regrouped(large.select("key", "m.*"), found, keep)))
        if left.isEmpty():
            return found.select("u", "v")
        stars = keep(left.join(_middles(docs, left, keep), ["key", "cls"]))
        asked = keep(stars.where("cls != cy").select(F.col("cls").alias("cx"), "cy", F.col("root").alias("ru"), "rv").distinct())
        met = keep(_shared(docs, asked))
        close = keep(met.where("ru != rv").where(_alike("s", "t", similarity)).select("u", "v", "ru", "rv").distinct())
        known = stars.join(met.select(F.col("cx").alias("cls"), "cy", "s"), ["cls", "cy"], "left").withColumn("s", F.coalesce("s", "n"))
        # what a set has beyond its middle, how much of that other sets may have, and what it lacks of the middle
        known = known.select("key", "cls", "root", F.struct((F.col("n") - F.col("s")).alias("more"), F.greatest(F.col("n") - F.col("s") - F.col("own"), F.lit(0)).alias("open"), (F.col("ny") - F.col("s")).alias("less"), "n").alias("p"))
        known = keep(_several(_regrouped(known, close, keep)))
        rest = _verified(docs, _open_pairs(known, similarity, keep), similarity)
        return written(found.select("u", "v").unionByName(close.select("u", "v")).unionByName(rest.select("u", "v")).distinct())


def _alike(shared: str, sizes: str, similarity: float) -> Column:
    """Whether two sets are similar, by the number of what they share and the sum of their sizes."""
    return F.col(shared) >= similarity * (F.col(sizes) - F.col(shared))


def _regrouped(members: DataFrame, found: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """members, their roots those of the components that the links found between roots (ru, rv) make."""
    tops = components(found.select(F.col("ru").alias("u"), F.col("rv").alias("v")), keep=keep).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return members.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def _several(members: DataFrame) -> DataFrame:
    """Members of buckets with more than one root."""
    return members.join(members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a != z").select("key"), "key", "left_semi")


def _middles(docs: DataFrame, left: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For every set of a bucket: key, cls, own (how many of its marks no other set has), and the bucket's middle: cy, its size ny and root rv.

    The middle is the set with most of the marks that are frequent among these sets and fewest of the others, so that others differ from it as little as they can.
    """
    marks = docs.join(left.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", F.explode("marks").alias("mark"))
    counted = marks.join(marks.groupBy("mark").agg(F.count("*").alias("f")), "mark").groupBy("cls")
    standing = counted.agg(F.sum(F.when(F.col("f") == 1, 1).otherwise(0)).cast("int").alias("own"), (2 * F.sum("f") / F.max("f") - F.count("*")).alias("o"))
    ranked = keep(left.join(standing, "cls"))
    top = ranked.groupBy("key").agg(F.max(F.struct("o", "cls", "n", "root")).alias("c")).select("key", F.col("c.cls").alias("cy"), F.col("c.n").alias("ny"), F.col("c.root").alias("rv"))
    return ranked.select("key", "cls", "own").join(top, "key")


def _open_pairs(known: DataFrame, similarity: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """x, y (cls, n, root): all pairs of a bucket, of different roots, that may be similar by what is known of each (p) against the bucket's middle.

    Marks in just one of two sets are those in just one of their differences from any third set. Of what they have beyond it, they share at most the
    smaller ``open`` part; what one lacks more than the other, the other has. Sets that are alike in this are told apart as one, and expanded only if a pair is left.
    """
    groups = known.groupBy("key", "p", "root").agg(F.count("*").alias("size"))
    kinds = keep(groups.groupBy("key", "p").agg(F.min("root").alias("a"), F.max("root").alias("z")))
    x, y = kinds.select("key", "p", "a", "z"), kinds.select("key", F.col("p").alias("q"), F.col("a").alias("b"), F.col("z").alias("w"))
    apart = F.col("p.more") + F.col("q.more") - 2 * F.least("p.open", "q.open") + F.abs(F.col("p.less") - F.col("q.less"))
    may = apart * (1 + similarity) <= (F.col("p.n") + F.col("q.n")) * (1 - similarity) + 1e-6
    fit = x.join(y, "key").where((F.col("p") <= F.col("q")) & may & (F.least("a", "b") != F.greatest("z", "w"))).select("key", "p", "q")
    two = fit.join(groups, ["key", "p"]).join(groups.select("key", F.col("p").alias("q"), F.col("root").alias("other")), ["key", "q"])
    two = keep(two.where((F.col("root") != F.col("other")) & ((F.col("p") < F.col("q")) | (F.col("root") < F.col("other")))))
    # a large group meets its partners in pieces
    piece = lambda n: F.ceil(F.col(n) / PIECE).cast("int")
    dealt = two.select("key", "p", "root", "q", "other", F.explode(F.sequence(F.lit(0), piece("size") - 1)).alias("piece"))
    of = lambda n: F.struct("cls", F.col(f"{n}.n").alias("n"), "root")
    left = known.join(groups, ["key", "p", "root"]).select("key", "p", "root", F.pmod(F.xxhash64("cls"), piece("size")).cast("int").alias("piece"), of("p").alias("x"))
    right = known.select("key", F.col("p").alias("q"), F.col("root").alias("other"), of("p").alias("y"))
    return dealt.join(left, ["key", "p", "root", "piece"]).join(right, ["key", "q", "other"]).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _shared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (written; of sets cx, cy) with fingerprints u, v, the number s of marks that both have and the sum t of their sizes."""
    # only sets of a pair are dealt
    wanted = pairs.select(F.col("cx").alias("cls")).union(pairs.select("cy")).distinct()
    sets = docs.join(wanted, "cls", "left_semi").select("cls", "fp", "marks").dropDuplicates(["cls"])
    both = pairs.join(sets.select(F.col("cls").alias("cx"), F.col("fp").alias("u"), F.col("marks").alias("mx")), "cx").join(sets.select(F.col("cls").alias("cy"), F.col("fp").alias("v"), F.col("marks").alias("my")), "cy")
    return both.select(*pairs.columns, "u", "v", F.size(F.array_intersect("mx", "my")).alias("s"), (F.size("mx") + F.size("my")).alias("t"))


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """u, v (fingerprints) and ru, rv (roots) of the pairs x, y of sets (cls, n, root) that are of different roots and similar."""
    able = (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n"))
    with passing(docs.sparkSession) as keep:
        pairs = keep(pairs.where(able).select(F.col("x.cls").alias("cx"), F.col("y.cls").alias("cy"), F.col("x.root").alias("ru"), F.col("y.root").alias("rv")).distinct())
        return written(_shared(docs, pairs).where(_alike("s", "t", similarity)).select("u", "v", "ru", "rv").distinct())


def _named(docs: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """docs with component_id."""
    tops = nodes.join(groups, nodes["node"] == groups["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(nodes, groups["fp"] == nodes["node"], "left").join(tops, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return docs.join(named, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id of the component) and text_hash of every row."""
    docs = written(fingerprints(df, id_col, text_col, shingle))
    groups = docs.groupBy("fp").agg(F.min("id").alias("least"))
    named = _named(docs, groups, components(links(groups.select("fp"), max_bits)))
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, wide: int = WIDE) -> DataFrame:
    """id, component_id and text_hash of every row: components of the links of fingerprints and of the links of texts of at least the given similarity of their shingles of ``wide`` words."""
    with passing(df.sparkSession) as keep:  # sets of shingles, by far the most, are not read again
        docs = keep(sketches(df, id_col, text_col, SHINGLE, wide))
        groups = docs.groupBy("fp").agg(F.min("id").alias("least"))
        close = links(groups.select("fp"))
        nodes = components(close.unionByName(similar(docs, components(close, keep=keep), similarity)), keep=keep)
        return written(_named(docs.select("id", "fp", "text_hash"), groups, nodes).select(F.col("id").alias(id_col), "component_id", "text_hash"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """df with one row of each component of similar_documents: that of the smallest id. Rows of one id with different texts, or without an id, count as documents of their own unless a smaller id is in their component."""
    named = similar_documents(df, id_col, text_col, similarity)
    # one key for the join and for repeated rows, so that texts are dealt once
    kept = named.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).alias("__key")).distinct()
    rows = df.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")))
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*df.columns)
