"""Mixing sources to target weights with soft memberships.

A multinomial logistic classifier (Spark ML, in the JVM), fitted on a bounded
sample of the labelled table, gives every document a posterior over domains. The
rates r >= 0 of the documents are fitted by projected-gradient least squares, so
that each domain's expected token total, sum of r * tokens * posterior, meets
its target. An iteration is one aggregation over a narrow table (tokens and
posteriors) to a handful of sums: the residual of every domain for some step
sizes, and the Gram matrix of the documents whose rate is not at zero, which
preconditions the gradient. Rates are never stored: they follow from the list of
steps taken. Only Spark functions touch the documents.

Defined cases: a null or empty text has no tokens and counts for no total; a
document labelled twice takes part in the sample twice; with labels of fewer than two domains every
posterior is the prior and all rates are alike; repeated rows have rates of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.llm.common import SPACE_CLASS, cut

#: Fixed order of the domains, and the weight that the targets give to each domain's present share of the tokens.
DOMAINS = ("clean", "low", "toxic")
EMPHASIS = {"clean": 1.0, "low": 0.5, "toxic": 0.5}
MAX_LABELLED, HASHED = 6000, 16_384
STEPS = (1.0, 0.5, 0.2, 0.05)


def domain_number() -> Column:
    """Domain of a row of labels: 2 toxic, else 1 for low quality, else 0."""
    return F.when(F.col("toxic") == 1, 2.0).when(F.col("quality") == 0, 1.0).when(F.col("quality") == 1, 0.0)


def featured(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / chars
    words = F.filter(F.split(F.lower(text), f"{SPACE_CLASS}+"), lambda w: w != "")
    return df.select("id", *keep, words.alias("words"), F.size(words).alias("tokens"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("double").alias("n_symbols"), share("[^A-Z]+").alias("capitals"), share("[^!]+").alias("marks")).withColumn("symbols", F.col("n_symbols") / F.greatest(F.col("tokens"), F.lit(1)))


def classifier(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int = MAX_LABELLED) -> PipelineModel | None:
    """Domain classifier from at most max_labelled labelled documents, by a hash of their ids."""
    known = labels.select(F.col(id_col).alias("id"), domain_number().alias("label")).dropna()
    # only labels of documents that are there count against the bound
    known = known.join(df.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(max_labelled))  # bounded by the limit
    rows = df.select(F.col(id_col).alias("id"), text_col).join(known, "id")
    rows = cut(featured(rows, text_col, "label"))
    if rows.select("label").distinct().count() < 2:
        return None
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=HASHED, binary=True)
    parts = [hashed, VectorAssembler(inputCols=["tf", "symbols", "capitals", "marks"], outputCol="features", handleInvalid="keep")]
    logistic = LogisticRegression(family="multinomial", regParam=3e-3, maxIter=30, standardization=False)
    return Pipeline(stages=[*parts, logistic]).fit(rows)


def memberships(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tokens and p (posteriors in the order of DOMAINS) of every row."""
    model = classifier(df, labels, id_col, text_col)
    rows = featured(df.select(F.col(id_col).alias("id"), text_col), text_col)
    if model is None:
        return rows.select("id", "tokens", F.array(*[F.lit(1 / len(DOMAINS))] * len(DOMAINS)).alias("p"))
    p = vector_to_array("probability")
    known = [F.coalesce(F.get(p, k), F.lit(0.0)) for k in range(len(DOMAINS))]
    return model.transform(rows).select("id", "tokens", F.array(*known).alias("p"))


def rate(steps: list[list[float]], p: Column) -> Column:
    """A document's rate after the given steps: each adds p . step and is projected onto r >= 0."""
    if not steps:
        return F.lit(1.0)
    dot = lambda s: sum(F.get(p, k) * F.get(s, k) for k in range(len(DOMAINS)))
    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps]), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r + dot(s)))


def fit_rates(members: DataFrame, weights: dict[str, float] | None, emphasis: dict[str, float] = EMPHASIS, rounds: int = 25, tolerance: float = 1e-7) -> tuple[list[list[float]], list[float]]:
    """Steps whose rates bring the domains' expected token totals to the weights' shares of all tokens (without weights: to the present shares times the emphasis, made to add up to one), and the last totals."""
    import numpy as np

    d, t = len(DOMAINS), F.col("tokens").cast("double")
    pairs = [(a, b) for a in range(d) for b in range(a, d)]

    def sums(options: list[list[list[float]]]) -> list[tuple]:
        """For each list of steps: totals of the domains and the Gram matrix of the free documents."""
        wide = members.select(t.alias("t"), "p", *[rate(s, F.col("p")).alias(f"r{i}") for i, s in enumerate(options)])
        part = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
        columns = []
        for i in range(len(options)):
            r = F.col(f"r{i}")
            columns += [part(r * F.col("t") * F.get("p", a)) for a in range(d)]
            columns += [part(F.when(r > 0, F.col("t") * F.get("p", a) * F.get("p", b))) for a, b in pairs]
        got, size = list(wide.agg(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()), d + len(pairs)
        return [(np.array(x[:d]), x[d:]) for x in (got[i * size : (i + 1) * size] for i in range(len(options)))]

    steps: list[list[float]] = []
    (totals, gram), *_ = sums([steps])
    everything = float(totals.sum())
    target = np.array([weights.get(k, 0.0) for k in DOMAINS]) if weights else totals * [emphasis.get(k, 1.0) for k in DOMAINS]
    target = target / max(target.sum(), 1e-12) * everything
    for _ in range(rounds):
        miss = totals - target
        if np.abs(miss).max() <= tolerance * max(everything, 1.0):
            break
        matrix = np.zeros((d, d))
        for (a, b), x in zip(pairs, gram):
            matrix[a, b] = matrix[b, a] = x
        direction = -np.linalg.lstsq(matrix, miss, rcond=1e-10)[0]
        options = [[*steps, (s * direction).tolist()] for s in STEPS]
        best = min(zip(sums(options), options), key=lambda o: float(((o[0][0] - target) ** 2).sum()))
        if ((best[0][0] - target) ** 2).sum() >= (miss**2).sum() * (1 - 1e-9):
            break
        (totals, gram), steps = best
    return steps, totals.tolist()


def mixed(df: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, p_<domain>, rate, and copies, a whole number with the rate as its mean, fixed by a hash of the id."""
    members = cut(memberships(df, labels, id_col, text_col))
    steps, _ = fit_rates(members, weights)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "id"), F.lit(1 << 32)) / float(1 << 32)
    return members.withColumn("rate", rate(steps, F.col("p"))).select(F.col("id").alias(id_col), F.col("tokens").cast("long").alias("n_tokens"), *[F.get("p", k).alias(f"p_{name}") for k, name in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"))


def resampled(df: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every row as often as its copies say."""
    copies = mixed(df, labels, weights, id_col, text_col).groupBy(F.col(id_col).alias("__mix_id")).agg(F.max("copies").alias("__mix_copies")).where("__mix_copies > 0")
    joined = df.join(copies, F.col(id_col).eqNullSafe(F.col("__mix_id")))
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*df.columns)
