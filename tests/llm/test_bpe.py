import hashlib
import random

import pytest
from helpers import documents, hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from hypolake.llm import bpe
from hypolake.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids(library, s):
    return library.encode(s or "", add_special_tokens=False).ids


def test_ids_and_digests_are_the_librarys(spark, library):
    rows = hard_rows(random.Random(4)) + [(20, "x" * 70_000), (21, "<|endoftext|> a <|endoftext|>"), (22, "it's  we'll\n\n  12345 !!!???"), (23, "ab" * 40_000 + " " + "!" * 3000)]
    got = bpe.encode_decode(documents(spark, rows), vocabulary_path(), with_ids=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for i, t in rows:
        n = ids(library, t)
        packed = b"".join(x.to_bytes(4, "little") for x in n)
        want.append((i, len(n), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(n, skip_special_tokens=False).encode()).hexdigest(), n))
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted(tuple(w[4]) for w in want)
    assert bpe.encode_decode(documents(spark, []), vocabulary_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the'sl\n\t 1!é漢🙂"), max_size=400))
def test_any_text(library, s):
    assert bpe.encode(vocabulary_path(), s) == ids(library, s)


def test_lookahead_is_enough_on_small_merge_lists():
    """Random merge lists: tokens emitted by the transducer are those of the whole text, whatever follows."""
    rng = random.Random(5)
    for _ in range(60):
        tokens = ["a", "b", "c"]
        merges = []
        for _ in range(rng.randint(1, 8)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((tokens.index(a), tokens.index(b), len(tokens) - 1))
        vocab = object.__new__(bpe.Vocabulary)
        vocab.token_bytes = [t.encode() for t in tokens]
        vocab.byte_id = [max(0, min(2, b - 97)) for b in range(256)]
        vocab.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
        vocab.lookahead = bpe.lookahead(merges, [len(t) for t in tokens])
        text = "".join(rng.choice("abc") for _ in range(300)).encode()
        whole = bpe.merge([vocab.byte_id[b] for b in text], vocab.ranks)
        t = bpe.Transducer(vocab, step=max(map(len, tokens)) + 1)
        got, held = [], 0
        for i in range(0, len(text), 7):
            got += list(t.feed(text[i : i + 7]))
            held = max(held, len(t.rest))
        assert got + list(t.finish()) == whole
        assert held <= vocab.lookahead + t.step + 7


def test_both_merge_loops_agree():
    rng = random.Random(6)
    v = bpe.Vocabulary(vocabulary_path())
    for _ in range(50):
        s = "".join(rng.choice(["the", "in", "ab", "e", "ing"]) for _ in range(40)).encode()[:100]
        whole = [v.byte_id[b] for b in s]
        assert bpe.merge(whole, v.ranks) == _short(whole, v.ranks)


def _short(seq, ranks):
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(seq, seq[1:])) if p in ranks]
        if not found:
            return seq
        _, i = min(found)
        seq = [*seq[:i], ranks[seq[i], seq[i + 1]][1], *seq[i + 2 :]]


def test_decoder_waits_for_the_rest_of_a_character(library):
    v = bpe.Vocabulary(vocabulary_path())
    n = ids(library, "漢字 🙂")
    d = bpe.Decoder(v)
    assert "".join(d.feed([i]) for i in n) + d.finish() == "漢字 🙂"
    d = bpe.Decoder(v)
    assert d.feed(n[:1]) + d.finish() == library.decode(n[:1])


def test_rows_are_handed_over_by_bytes(spark, monkeypatch):
    rows = hard_rows(random.Random(12))
    whole = bpe.encode_decode(documents(spark, rows), vocabulary_path(), with_ids=True).collect()
    monkeypatch.setattr(bpe, "OUT_BYTES", 40)
    source = bpe.encode_decode(documents(spark, rows).coalesce(1), vocabulary_path(), with_ids=True)
    assert sorted(map(str, source.collect())) == sorted(map(str, whole))
