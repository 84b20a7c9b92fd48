"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

How far a later byte can change an earlier token is bounded by the merge list
alone. ``lookahead`` walks the merges once in order of rank and keeps, for every
token that may stand at the left edge of the undecided zone, how wide that zone
can be: a merge (u, v) lets the zone grow by len(u) when v may lead it. Tokens
that end further than that from the end of what has been read are final and are
emitted; only the undecided rest stays in memory.

Texts are cut into pre-tokens first; the bytes of every pre-token go through the
transducer, and its end is a flush point. What the transducer gave for a short
pre-token is kept in a memo bounded by bytes, so that a frequent one passes once.

Defined cases: a null text counts as empty (no ids); the special token's string
in a text becomes its id; repeated rows are encoded each for itself; an empty
table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hypolake.llm.common import small_batches

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a text looked at together, characters of a pre-token fed at once, bytes that the transducer decides at a time, and characters of a pre-token and bytes of all that the memo takes.
SLICE, PIECE, STEP, MEMO_WORD, MEMO_BYTES = 1 << 16, 1024, 128, 64, 40 << 20
#: Bytes of ids after which rows are handed over.
OUT_BYTES = 4 << 20


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Rank of a pair that no merge joins.
NONE = (1 << 30, -1)


class Vocabulary:
    """Merges and tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        vocab = spec["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * self.size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.byte_id = [0] * 256
        for text, i in vocab.items():
            if len(text) == 1:
                self.byte_id[chars[text]] = i
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.ranks = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(self.merges)}
        self.lookahead = lookahead(self.merges, [len(t) for t in self.token_bytes])


def lookahead(merges: list[tuple[int, int, int]], lengths: list[int]) -> int:
    """Bytes after a token's end that are enough to know that it stays, from the merge list alone."""
    reach = [0] * len(lengths)
    for a, b, whole in merges:
        grown = reach[b] + lengths[a]
        reach[whole] = max(reach[whole], reach[a], grown)
        reach[a] = max(reach[a], grown)
    return max([*reach, *lengths, 1])


def merge(ids: list[int], ranks: dict) -> list[int]:
    """The merges applied to a whole sequence, lowest rank first and from the left."""
    if len(ids) <= 64:
        ids, get = list(ids), ranks.get
        found = [get(p, NONE) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = best[1:]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NONE)
        return ids
    n = len(ids)
    ids, left, right = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := ranks.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, whole = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], right[i] = whole, -1, right[j]
        if right[i] >= 0:
            left[right[i]] = i
            if f := ranks.get((whole, ids[right[i]])):
                heapq.heappush(heap, (f[0], i, whole, ids[right[i]], f[1]))
        if left[i] >= 0 and (f := ranks.get((ids[left[i]], whole))):
            heapq.heappush(heap, (f[0], left[i], ids[left[i]], whole, f[1]))
    return [i for i in ids if i >= 0]


class Transducer:
    """Tokens of a byte stream, emitted once no later byte can change them."""

    def __init__(self, vocab: Vocabulary, step: int = STEP):
        self.vocab, self.step, self.rest = vocab, step, b""

    def feed(self, data: bytes) -> Iterator[int]:
        self.rest += data
        while len(self.rest) >= self.vocab.lookahead + self.step:
            window, limit, at = self.rest[: self.vocab.lookahead + self.step], self.step, 0
            for t in self._tokens(window):
                end = at + len(self.vocab.token_bytes[t])
                if end > limit:
                    break
                yield t
                at = end
            self.rest = self.rest[at:]

    def finish(self) -> Iterator[int]:
        yield from self._tokens(self.rest)
        self.rest = b""

    def _tokens(self, data: bytes) -> list[int]:
        return merge([self.vocab.byte_id[b] for b in data], self.vocab.ranks)


class Decoder:
    """Text of a stream of ids; an incomplete character waits for its other bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.vocab.token_bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class _Memo(dict):
    """What the transducer gave for pre-tokens, as packed bytes; emptied when full."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.size = vocab, 0

    def __missing__(self, word: str) -> bytes:
        out = b"".join(stream(self.vocab, word, 0, len(word)))
        if len(word) <= MEMO_WORD:
            if self.size >= MEMO_BYTES:
                self.clear()
                self.size = 0
            self.size += 160 + 4 * len(word) + len(out)  # with the objects' own bytes
            self[word] = out
        return out


def pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def stream(vocab: Vocabulary, text: str, start: int, end: int) -> Iterator[bytes]:
    """Packed ids of one pre-token, piece by piece."""
    t = Transducer(vocab)
    for at in range(start, end, PIECE):
        yield pack(list(t.feed(text[at : min(at + PIECE, end)].encode())))
    yield pack(list(t.finish()))


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Vocabulary, _Memo, regex.Pattern]:
    vocab = Vocabulary(path)
    return vocab, _Memo(vocab), regex.compile(PATTERN)


def encode_stream(path: str, text: str | None) -> Iterator[bytes]:
    """Little-endian 32-bit ids of a whole text, in pieces of bounded size."""
    vocab, memo, pattern = _loaded(path)
    text, at = text or "", 0
    special = list(vocab.special)
    while at < len(text):
        stops = [(i, s) for s in special if (i := text.find(s, at)) >= 0]
        stop, mark = min(stops, default=(len(text), None))
        yield from _segment(vocab, memo, pattern, text, at, stop)
        if mark is None:
            break
        yield vocab.special[mark].to_bytes(4, "little")
        at = stop + len(mark)


def _segment(vocab, memo, pattern, text: str, at: int, stop: int) -> Iterator[bytes]:
    get = memo.__getitem__
    while at < stop:
        end = min(at + SLICE, stop)
        if end < stop:
            # no pre-token goes on from a visible character to a blank
            end = text.rfind(" ", at + 1, end)
            while end > at and text[end - 1].isspace():
                end = text.rfind(" ", at + 1, end)
        if end > at:
            yield b"".join(map(get, pattern.findall(text[at:end])))
            at = end
            continue
        limit = at + SLICE
        for m in pattern.finditer(text, at, stop):
            if m.end() - m.start() > MEMO_WORD:
                yield from stream(vocab, text, m.start(), m.end())
            else:
                yield get(m.group())
            at = m.end()
            if at >= limit:
                break


def encode(path: str, text: str | None) -> list[int]:
    data = b"".join(encode_stream(path, text))
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text, decodes the ids again, and returns per row the number of ids and digests of the ids and of the decoded text; with_ids adds the ids themselves as an array."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        vocab, _, _ = _loaded(vocabulary)
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

        def part(batch: pa.RecordBatch, first: int, rows: list[tuple]) -> pa.RecordBatch:
            ns, id_digests, text_digests, kept = zip(*rows)
            cols = [batch.column(0).slice(first, len(rows)), pa.array(ns, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if with_ids:
                # bytes of ids go to Arrow as they are, without an object for each id
                edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in kept])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(kept), "<i4"))))
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            rows, first, held = [], 0, 0
            for at, text in enumerate(batch.column(1)):
                ids_sha, text_sha, n, decoder, own = hashlib.sha256(), hashlib.sha256(), 0, Decoder(vocab), []
                for piece in encode_stream(vocabulary, text.as_py()):
                    ids_sha.update(piece)
                    ids = np.frombuffer(piece, "<u4").tolist()
                    n += len(ids)
                    text_sha.update(decoder.feed(ids).encode())
                    if with_ids:
                        own.append(piece)
                text_sha.update(decoder.finish().encode())
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), b"".join(own)))
                held += 4 * n * with_ids
                if held >= OUT_BYTES:
                    yield part(batch, first, rows)
                    rows, first, held = [], at + 1, 0
            if rows:
                yield part(batch, first, rows)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return small_batches(df).select(id_col, text_col).mapInArrow(run, schema)
