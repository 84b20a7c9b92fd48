import random
import re

from helpers import documents, hard_rows, text

from hypolake.llm import licenses


def slow(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


CASES = [
    (50, "Released under the MIT License. MIT\n\nlicense"), (51, "Licensed under the Apache License, Version 2.0."), (52, "the GNU General Public-License; mit licenses"),
    (53, "Licensed under CC BY-NC 4.0."), (54, "Licenced undr the Apache Licence, Version 2.0"), (55, "Permission is herby granted, free of charge, to any persn obtaining a copy"), (56, "an apache helicopter and a driving license"), (57, "MIT LICENSE éMIT license"),
]


def test_base_against_brute_force(spark):
    rows = hard_rows(random.Random(7)) + CASES
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, t in rows:
        want = slow(t)
        r = got[i, want[0]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, want[4].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if want[1] else True)


def test_edited_notices_are_found_and_clean_text_is_not(spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, CASES)).collect()}
    assert got[53]["labels"] == "cc-by-nc" and got[54]["labels"] == "apache" and got[55]["labels"] == "mit" and got[56]["labels"] == ""
    assert 0 < got[54]["score"] < 1 and got[54]["spans"][0]["edits"] > 0
    assert got[53]["spans"][0]["first_word"] == 0
    rng = random.Random(8)
    clean = licenses.scan(documents(spark, [(i, text(rng, 200)) for i in range(50)]))
    assert clean.where("labels != ''").count() == 0
    assert licenses.scan(documents(spark, [])).count() == 0


def test_pieces_find_every_match_within_the_edits():
    """Notices with random edits up to the bound are all found, at the bound too."""
    rng = random.Random(9)
    some = licenses.notices()
    for notice in some:
        for _ in range(15):
            s = list(notice.text)
            for _ in range(notice.edits):
                i = rng.randrange(len(s))
                kind = rng.randrange(3)
                if kind == 0:
                    s[i] = rng.choice("xyz")
                elif kind == 1:
                    del s[i]
                else:
                    s.insert(i, "q")
            flat = f" before {''.join(s)} after "
            assert any(label == notice.label for _, _, label, _, _ in licenses.search(flat, (notice,)))


def test_long_texts_take_linear_time_and_spans_are_those_of_a_scan_of_the_whole_text():
    import time

    def run(n):
        flat = b" " + b" ".join(licenses.words_of("mit license " * n)) + b" "
        began = time.process_time()
        assert len(licenses.base_places(flat)) == n and licenses.base_places(flat)[-1] == (2 * n - 2, "mit")
        return time.process_time() - began

    assert run(80_000) < 1
    text = " the of released undr the mit licence and water licensed under cc by sa river gnu leser general public license stone "
    got = licenses.search(text, licenses.notices())
    want = set()
    for notice in licenses.notices():
        for m in notice.pattern.finditer(text):
            want.add((m.start(), m.end(), notice.label, sum(m.fuzzy_counts)))
    labels = {"mit", "cc-by-sa", "lgpl"}
    assert labels <= {g[2] for g in got}
    assert {g[:4] for g in got if g[2] in labels} <= want
