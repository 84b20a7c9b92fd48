"""Quality rules as weak supervision.

Every rule votes good (+1), votes bad (-1) or abstains (0) on a document; every
kind of junk is looked at by several rules. The patterns of votes are counted over
all documents (at most 3^rules rows whatever the corpus). Expectation-maximisation
over these counts estimates a latent class of good documents and some of bad ones,
one for each kind of junk, with the probabilities of each rule's votes in each
class: the rules' accuracies. They are proper probabilities under a weak prior
that rules are right more often than not. Of several starts and numbers of kinds
the fit with the least Bayesian information criterion is taken; no labels are read.
A document's posterior probability of being good replaces a filter that all rules
must pass: a lone bad vote can be outvoted. Only Spark functions touch the
documents; nothing is shuffled but the counts.

Words are runs of anything but ASCII white space. Windows of WINDOW words are
compared inside a document by 64-bit hashes.

Defined cases: a null text counts as empty; a document without words abstains
in every rule and fails the base rules; repeated rows are counted and judged each
for itself; an empty table gives an empty result; columns other than the two named
are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import SPACE_CLASS, written

WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
KEEP_FROM = 0.5
#: Kinds of junk that are tried, starts for each, and pseudo-counts of the prior: of every vote, and more of the right one.
KINDS, STARTS, EVEN, RIGHT = (1, 2, 3, 4), 8, 0.5, 1.0


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and counts of every row; one pass, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col), text.alias("t")).withColumn("w", F.filter(F.split("t", f"{SPACE_CLASS}+"), lambda x: x != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", lines)
    # hashes of all windows; places of those that are there twice, in order
    hashes = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("h", hashes)
    ordered = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("o", ordered)
    same = lambda x, j: F.coalesce(F.get("o", j)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("o", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    base = base.withColumn("p", places)
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return base.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^.!?。！？]+", "")).cast("long").alias("n_stops"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote: +1, -1 or 0. Symbols, letters and word length look at symbol junk; repeats, variety and lines at repetition; capitals, letters and sentences at shouting."""
    n, chars = F.col("n_words"), F.col("word_chars")
    per = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    some, enough, lines = n > 0, n >= MIN_WORDS, F.col("n_lines") > 1
    symbols, letters, capitals = per(F.col("n_symbols"), n), per(F.col("n_letters"), chars), per(F.col("n_upper"), chars)
    repeats, variety, again = per(F.col("n_repeat_words"), n), per(F.col("n_distinct"), n), per(F.col("n_dup_lines"), F.col("n_lines"))
    stops, mean = per(F.col("n_stops"), n), per(chars, n)
    vote = lambda able, good, bad: F.when(able & bad, -1).when(able & good, 1).otherwise(0)
    return {
        "length": vote(some, n >= 50, n < MIN_WORDS),
        "symbols": vote(some, symbols < 0.02, symbols > 0.3),
        "letters": vote(some, letters > 0.9, letters < 0.8),
        "repeats": vote(enough, repeats < 0.05, repeats > MAX_REPEATED_PERCENT / 100),
        "variety": vote(enough, variety > 0.5, variety < 0.3),
        "lines": vote(lines, again == 0, again > 0.3),
        "capitals": vote(some, capitals < 0.1, capitals > 0.3),
        "sentences": vote(enough, stops.between(0.02, 0.4), (stops < 0.002) | (stops > 0.8)),
        "word_length": vote(enough, mean.between(3, 6.5), (mean < 2) | (mean > 7.5)),
    }


class Fit(NamedTuple):
    """Share of good documents; for each rule its votes with P(vote | good) and P(vote | bad); priors of the classes (good first) and P(vote | class) by class, rule and vote."""

    share: float
    accuracies: list[dict[int, tuple[float, float]]]
    priors: list[float]
    tables: list[list[dict[int, float]]]


VOTES = (-1, 0, 1)


def maximise(patterns, counts, weights):
    """Priors and tables (class, rule, vote) with the highest posterior density for documents that belong to classes by the weights."""
    import numpy as np

    classes = weights.shape[1]
    mass = weights * counts[:, None]
    priors = (mass.sum(axis=0) + 1) / (counts.sum() + classes)
    prior = np.full((classes, 1, len(VOTES)), EVEN)
    prior[0, 0, 2] += RIGHT
    prior[1:, 0, 0] += RIGHT
    tables = np.stack([mass.T @ (patterns == v) for v in VOTES], axis=2) + prior
    return priors, tables / tables.sum(axis=2, keepdims=True)


def expect(patterns, priors, tables):
    """Weights of the classes for each pattern, and the log likelihood of each."""
    import numpy as np

    logs = np.log(priors)[None, :] + sum((patterns == v) @ np.log(tables[:, :, k]).T for k, v in enumerate(VOTES))
    top = logs.max(axis=1, keepdims=True)
    e = np.exp(logs - top)
    return e / e.sum(axis=1, keepdims=True), top[:, 0] + np.log(e.sum(axis=1))


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = 300) -> Fit:
    """The classes, by EM from counts of vote patterns; whatever the order of the counts."""
    import numpy as np

    counts = sorted((p, n) for p, n in counts if n > 0)
    if not counts:
        return Fit(0.5, [], [], [])
    patterns, n = np.array([p for p, _ in counts]), np.array([float(c) for _, c in counts])
    lean = (patterns == 1).sum(axis=1) - 2.0 * (patterns == -1).sum(axis=1)
    good = 1 / (1 + np.exp(-lean))
    best = None
    for kinds in KINDS:
        for start in range(STARTS if kinds > 1 else 1):
            # a start deals the patterns that lean to bad to the kinds
            dealt = np.random.default_rng(start).dirichlet(np.full(kinds, 0.3), size=len(n)) if kinds > 1 else np.ones((len(n), 1))
            weights = np.concatenate([good[:, None], (1 - good)[:, None] * dealt], axis=1)
            for _ in range(rounds):
                priors, tables = maximise(patterns, n, weights)
                new, log = expect(patterns, priors, tables)
                moved, weights = np.abs(new - weights).max(), new
                if moved < 1e-8:
                    break
            free = kinds + 2 * tables.shape[0] * tables.shape[1]
            cost = -2 * float((n * log).sum()) + free * math.log(n.sum())
            if best is None or cost < best[0] - 1e-6:
                best = cost, priors, tables
    _, priors, tables = best
    bad = np.einsum("k,krv->rv", priors[1:] / priors[1:].sum(), tables[1:])
    accuracies = [{v: (float(tables[0, r, k]), float(bad[r, k])) for k, v in enumerate(VOTES)} for r in range(tables.shape[1])]
    return Fit(float(priors[0]), accuracies, priors.tolist(), [[{v: float(t[k]) for k, v in enumerate(VOTES)} for t in rules] for rules in tables])


def posterior(found: Fit, names: list[str]) -> Column:
    """P(good | votes) from the columns of votes."""
    logs = []
    for prior, rules in zip(found.priors, found.tables):
        x = F.lit(math.log(prior))
        for name, t in zip(names, rules):
            x = x + F.when(F.col(name) == 1, math.log(t[1])).when(F.col(name) == -1, math.log(t[-1])).otherwise(math.log(t[0]))
        logs.append(x)
    if not logs:
        return F.lit(None).cast("double")
    return 1 / sum((F.exp(x - logs[0]) for x in logs[1:]), F.lit(1.0))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row: the counts, base_failed, kept, posterior and the rules' votes."""
    rules = votes()
    voted = with_statistics(df, id_col, text_col).withColumns({f"vote_{k}": v.cast("int") for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    voted = written(voted)  # a few numbers a document, so that texts are read once
    counts = [(tuple(r[c] for c in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]  # at most 3^rules rows
    return voted.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(fit(counts), names)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from)).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *names)
