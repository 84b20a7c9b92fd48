"""Exact top-k inner-product search on a bit-sliced index.

Vectors are packed, as they are read, into blocks that hold for every component
the bit slices of its quantised value (the low bits beyond KEPT_BITS are left
out) and the exact integers, in the least width that takes them. A query adds the
slices of a block, each as often as the bits of its own component say, with bitmap
arithmetic only (carry-save adders), which gives the quantised score of all rows
as slices again. From the most significant slice downward the k best rows and the
least quantised score among them are found; rows that could still reach it, by the
bound on what the low bits add, are the boundary, and their scores are computed
exactly.

Blocks stay where they are made and are never shuffled. Queries are dealt by a
hash of their ids into groups of about GROUP_BYTES, and a group at a time is sent
to all blocks: what is sent at once is bounded whatever the number of queries, and
with several groups the sliced blocks are written once and read for each. Only k
rows a query and task are shuffled, to be ranked.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id; only vectors of the query's
length are compared with it; rows with the query's id are its own and no
candidates; repeated candidate rows take a rank each; of repeated query rows the
least vector counts; ties go to the smaller id; scores beyond 64 bits are cut to
the range of a long; an empty table gives an empty result; columns other than
the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypolake.llm.common import written, written_in_turn

#: Bits of a component in the index; rows and bytes of a block of candidates, at most; bytes of queries that are sent at once, about, and searched at once.
KEPT_BITS, BLOCK_ROWS, BLOCK_BYTES, GROUP_BYTES, AT_ONCE = 6, 16_384, 1 << 25, 1 << 24, 64
SCALE = 256

BLOCK_COLUMNS = ["dim", "shift", "m", "width", "ids", "packed", "slices"]


class Sum:
    """Sum of bitmaps by bit position in carry-save form: never more than two bitmaps wait at a position."""

    def __init__(self):
        self.planes: dict[int, list] = {}

    def add(self, p: int, plane) -> None:
        waiting = self.planes.setdefault(p, [])
        waiting.append(plane)
        while len(waiting) == 3:
            a, b, c = waiting
            half = a ^ b
            waiting[:] = [half ^ c]
            p += 1
            waiting = self.planes.setdefault(p, [])
            waiting.append((a & b) | (half & c))

    def slices(self) -> list:
        """Slices of the total, least first; None for an empty one."""
        out, p = [], 0
        while any(q >= p and x for q, x in self.planes.items()):
            waiting = self.planes.pop(p, [])
            if len(waiting) == 2:
                self.add(p + 1, waiting[0] & waiting[1])
                waiting = [waiting[0] ^ waiting[1]]
            out.append(waiting[0] if waiting else None)
            p += 1
        return out


class Block:
    """A block of candidates: ids, exact integers, and slices[d][b] as bitmaps."""

    def __init__(self, ids, values):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        low, high = self.values.min(axis=0), self.values.max(axis=0)
        bits = int(max(int(h) - int(b) for h, b in zip(high, low))).bit_length()
        self.shift = max(0, bits - KEPT_BITS)
        self.m = max(1, bits - self.shift)
        # differences of 64-bit integers fit into unsigned ones
        quantised = ((self.values.astype(np.uint64) - low.astype(np.uint64)) >> np.uint64(self.shift)).astype(np.uint16)
        n = len(ids)
        self.words = -(-n // 64)
        padded = np.zeros((self.words * 64, quantised.shape[1]), np.uint16)
        padded[:n] = quantised
        self.slices = np.stack([[np.packbits((padded[:, d] >> b).astype(np.uint8) & 1, bitorder="little").view(np.uint64) for b in range(self.m)] for d in range(values.shape[1])])
        self._ends()

    def _ends(self) -> None:
        import numpy as np

        n = len(self.ids)
        self.least, self.most = int(self.values.min()), int(self.values.max())
        self.real = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def packed(self) -> tuple[int, int, int, bytes, bytes, bytes]:
        """Bits left out, slices of a component, bytes of a value, and ids, values and slices."""
        import numpy as np

        width = next(w for w in (1, 2, 4, 8) if w == 8 or (-(1 << 8 * w - 1) <= self.least and self.most < 1 << 8 * w - 1))
        return self.shift, self.m, width, self.ids.tobytes(), self.values.astype(np.dtype(f"<i{width}")).tobytes(), self.slices.tobytes()

    @classmethod
    def unpacked(cls, dim: int, shift: int, m: int, width: int, ids: bytes, values: bytes, slices: bytes) -> Block:
        import numpy as np

        self = cls.__new__(cls)
        self.shift, self.m, self.ids = shift, m, np.frombuffer(ids, np.int64)
        self.values = np.frombuffer(values, np.dtype(f"<i{width}")).reshape(-1, dim)
        self.words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(slices, np.uint64).reshape(dim, m, self.words)
        self._ends()
        return self

    def quantised_scores(self, queries):
        """Slices (least first, each of queries x words) of sum |q_d| * (u_d or its complement)."""
        import numpy as np

        size = np.abs(queries)
        negative = np.where(queries < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, :, None]
        total = Sum()
        for d in range(queries.shape[1]):
            digits = int(size[:, d].max()).bit_length()
            masks = [np.where(size[:, d] >> i & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None] for i in range(digits)]
            for b in range(self.m):
                plane = self.slices[d][b][None, :] ^ negative[:, d]
                for i, mask in enumerate(masks):
                    total.add(b + i, plane & mask)
        return total.slices()

    def search(self, query_ids, queries, k: int) -> Iterator[tuple[int, int, int]]:
        """query id, row id, score of each query's k best rows here."""
        import numpy as np

        slices = self.quantised_scores(queries)
        wide = int(np.abs(queries).max(initial=0)) * max(abs(self.least), abs(self.most)) * queries.shape[1] >= 1 << 62
        for q in range(len(queries)):
            # the low bits add between 0 and 2^shift - 1 for each unit of |q|, in either direction
            slack = int(np.abs(queries[q]).sum()) if self.shift else 0
            alive = self.real.copy()
            lo, hi = np.searchsorted(self.ids, query_ids[q], "left"), np.searchsorted(self.ids, query_ids[q], "right")
            for own in range(lo, hi):
                alive[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
            if not (count := int(np.bitwise_count(alive).sum())):
                continue
            row = [None if s is None else s[q] for s in slices]
            rows = self._above(row, alive, self._least(row, alive, min(k, count)) - slack)
            exact = self.values[rows].astype(object if wide else np.int64) @ (queries[q].astype(object) if wide else queries[q])
            best = np.lexsort((self.ids[rows], -exact))[:k] if not wide else sorted(range(len(rows)), key=lambda i: (-exact[i], self.ids[rows[i]]))[:k]
            for i in best:
                yield int(query_ids[q]), int(self.ids[rows[i]]), max(-(1 << 63), min((1 << 63) - 1, int(exact[i])))

    @staticmethod
    def _least(slices, alive, k: int) -> int:
        """The k-th highest value, from the most significant slice downward."""
        import numpy as np

        tied, above, value = alive, 0, 0
        for p in range(len(slices) - 1, -1, -1):
            ones = tied & slices[p] if slices[p] is not None else np.zeros_like(tied)
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                tied, value = ones, value | 1 << p
            else:
                above, tied = above + n, tied & ~ones
        return value

    @staticmethod
    def _above(slices, alive, least: int):
        """Numbers of the rows whose value is at least ``least``."""
        import numpy as np

        if least <= 0:
            hit = alive
        else:
            tied, hit = alive, np.zeros_like(alive)
            for p in range(len(slices) - 1, -1, -1):
                plane = slices[p] if slices[p] is not None else np.zeros_like(alive)
                if least >> p & 1:
                    tied = tied & plane
                else:
                    hit, tied = hit | (tied & plane), tied & ~plane
            hit = hit | tied
        return np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and v (integers) of the rows that take part."""
    x = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _packed(block_rows: int):
    """Blocks of rows of one length, from what a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        waiting: dict[int, list] = {}

        def give(d: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*waiting.pop(d)))
            row = (d, *Block(ids, values).packed())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int32()] * 4 + [pa.binary()] * 3)], BLOCK_COLUMNS)

        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.values.to_numpy()
            starts = v.offsets.to_numpy()[:-1]
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                most = max(64, min(block_rows, BLOCK_BYTES // (8 * int(d))))
                for a in range(0, len(rows), most):
                    some = rows[a : a + most]
                    waiting.setdefault(int(d), []).append((ids[some].astype(np.int64), flat[starts[some][:, None] + np.arange(d)].astype(np.int64)))
                    if sum(len(x[0]) for x in waiting[int(d)]) >= most:
                        yield give(int(d))
        for d in list(waiting):
            yield give(d)

    return run


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns[:-1]]
                block, own = Block.unpacked(*row), batch.columns[-1][i].values
                ids, flat = own.field(0).to_numpy(), own.field(1).flatten().to_numpy().reshape(-1, row[0])
                found = []
                for a in range(0, len(ids), AT_ONCE):
                    found += block.search(ids[a : a + AT_ONCE], flat[a : a + AT_ONCE], k)
                cols = list(zip(*found)) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The sliced blocks of df's vectors, one row each."""
    return integer_vectors(df, id_col, vector_col, scale).mapInArrow(_packed(block_rows), "dim int, shift int, m int, width int, ids binary, packed binary, slices binary")


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of df with the highest integer inner product with each row of queries (same columns)."""
    asked = integer_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = asked.agg(F.sum(8 * (F.size("v") + 1))).first()[0] or 0
    groups = max(1, ceil(size / group_bytes))
    blocks = index(df, id_col, vector_col, scale)
    if groups > 1:
        blocks, asked = written(blocks), written(asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def ranked(g: int) -> DataFrame:
        group = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).groupBy(F.size("v").alias("dim")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
        pairs = blocks.join(F.broadcast(group), "dim")  # about group_bytes
        found = pairs.select(*BLOCK_COLUMNS, "queries").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # a query's rows all come from its own group, so that each group's k rows are final
    return ranked(0) if groups == 1 else written_in_turn(ranked(g) for g in range(groups))
