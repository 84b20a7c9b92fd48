"""License scans: exact phrases, and short notices with a bounded number of edits.

Texts are lower-cased (A-Z only) and reduced to their words. A notice of m
characters with at most k edits contains one of its k + 1 pieces unchanged
(pigeonhole), so exact search of the pieces finds all candidates; around each the
regex library's bounded-error matching verifies the notice and gives its span.

Defined cases: a null text counts as empty; repeated rows are scanned each for
itself; an empty table gives an empty result; texts are scanned whole whatever
their length; columns other than the two named are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hypolake.llm.common import small_batches

#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, as words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license version": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Characters of a notice for each allowed edit.
CHARS_PER_EDIT = 12

_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[int, str], ...]
    pattern: regex.Pattern


@lru_cache
def notices(chars_per_edit: int = CHARS_PER_EDIT) -> tuple[Notice, ...]:
    out = []
    for text, label in NOTICES.items():
        k = len(text) // chars_per_edit
        bounds = [len(text) * i // (k + 1) for i in range(k + 2)]
        seeds = tuple((a, text[a:b]) for a, b in zip(bounds, bounds[1:]))
        out.append(Notice(text, label, k, seeds, regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}")))
    return tuple(out)


def search(flat: str, some: tuple[Notice, ...]) -> list[tuple[int, int, str, int, int]]:
    """start, end, label, edits and allowed edits of the verified notices in a text of words joined by blanks."""
    found = set()
    for notice in some:
        for offset, seed in notice.seeds:
            at = flat.find(seed)
            while at >= 0:
                lo, hi = max(0, at - offset - notice.edits), min(len(flat), at - offset + len(notice.text) + notice.edits)
                m = notice.pattern.search(flat, lo, hi)
                if m:
                    found.add((m.start(), m.end(), notice.label, sum(m.fuzzy_counts), notice.edits))
                at = flat.find(seed, at + 1)
    # of overlapping spans of one label the one with the fewest edits stays; those that stay are apart, so only neighbours can overlap
    kept: dict[str, list[tuple[int, int, str, int, int]]] = {}
    for span in sorted(found, key=lambda s: (s[3], s[0], s[1])):
        own = kept.setdefault(span[2], [])
        i = bisect(own, span)
        if not (i and own[i - 1][1] > span[0]) and not (i < len(own) and own[i][0] < span[1]):
            own.insert(i, span)
    return sorted(x for own in kept.values() for x in own)


def word_numbers(flat: bytes, places: list[int]) -> list[int]:
    """Number of blanks before each of the ascending places, in one pass."""
    out, last, n = [], 0, 0
    for at in places:
        n += flat.count(b" ", last, at)
        out.append(n)
        last = at
    return out


def base_places(flat: bytes) -> list[tuple[int, str]]:
    """First word's number and label of every place of a phrase in b' words joined by blanks '."""
    found = []
    for phrase, label in PHRASES.items():
        key = b" " + phrase.encode() + b" "
        at = flat.find(key)
        while at >= 0:
            found.append((at, label))
            at = flat.find(key, at + 1)
    found.sort()
    return list(zip(word_numbers(flat, [at for at, _ in found]), [label for _, label in found]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per row: n_words, the base phrases' number, first and last word and labels, all labels, a score (1 for a phrase or an unchanged notice, less for each edit, 0 without a finding), and spans (first word, words, label, edits) of the notices."""
    id_type = df.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = notices(chars_per_edit)
        seeds = [s.encode() for n in some for _, s in n.seeds]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                flat = b" " + b" ".join(words) + b" "
                base = base_places(flat)
                spans = []
                if any(s in flat for s in seeds):
                    found = search(flat.decode("latin-1"), some)  # a byte is a character, so that places stay; notices are ASCII
                    numbers = word_numbers(flat, [a + 1 for a, *_ in found])
                    spans = [{"first_word": max(0, i - 1), "n_words": len(flat[a:b].split()), "label": label, "edits": e, "k": k} for i, (a, b, label, e, k) in zip(numbers, found)]
                labels = sorted({x for _, x in base})
                every = sorted({*labels, *(s["label"] for s in spans)})
                score = max([1.0 if base else 0.0, *(1 - s["edits"] / (s.pop("k") + 1) for s in spans)])
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(labels), ",".join(every), score, spans))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:bigint,n_words:bigint,label:string,edits:int>>"
    return small_batches(df).select(id_col, text_col).mapInArrow(run, schema)
