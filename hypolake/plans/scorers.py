"""Scorers of pairs as Column expressions, with a registry, and the plug-in ways for others.

A scorer maps the columns of a cohort to a struct of predicted_p_approval,
predicted_tier, top_supporting_dims, top_concerning_dims, score_confidence and
n_features_used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.operators.relational import with_rank
from hypolake.plans.evidence_tests import RS_FACTORS, RS_WEIGHTS

Scorer = Callable[[], Column]
SCORERS: dict[str, tuple[Scorer, str]] = {}
OUTPUT = "struct<predicted_p_approval:double,predicted_tier:string,top_supporting_dims:array<string>,top_concerning_dims:array<string>,score_confidence:string,n_features_used:int>"

#: Probability of each tier of genetic support, and its text.
TIER_P = {"T4": (0.45, "T4 (Mendelian direction-matched)"), "T3": (0.35, "T3 (Mendelian match)"), "T2": (0.28, "T2 (GWAS coding)"), "T1": (0.22, "T1 (GWAS non-coding)"), "T0": (0.15, "T0 (no genetic support)")}
TIER_POINTS = {"T4": 1.0, "T3": 0.7, "T2": 0.5, "T1": 0.3, "T0": -0.2}


def register(name: str, version: str = "v1") -> Callable[[Scorer], Scorer]:
    def put(f: Scorer) -> Scorer:
        SCORERS[name] = (f, version)
        return f

    return put


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))


def tier(p: Column) -> Column:
    return F.when(p >= 0.35, "high").when(p >= 0.18, "medium").otherwise("low")


def confidence(n: Column) -> Column:
    return F.when(n >= 15, "high").when(n >= 8, "medium").otherwise("low")


def texts(*items: Column) -> Column:
    """An array of the texts that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")


def result(p: Column, supporting: Column, concerning: Column, sure: Column, used: Column) -> Column:
    return F.struct(p.alias("predicted_p_approval"), tier(p).alias("predicted_tier"), supporting.alias("top_supporting_dims"), concerning.alias("top_concerning_dims"), sure.alias("score_confidence"), used.cast("int").alias("n_features_used")).cast(OUTPUT)


def number(c: Column) -> Column:
    return c.cast("long").cast("string")


def two_digits(c: Column) -> Column:
    return F.format_string("%.2f", c)


@register("random_v1")
def random_scorer() -> Column:
    """Uniform by a hash of the pair, so that a rerun gives the same."""
    p = F.pmod(F.xxhash64(F.lit("random"), "target_id", "indication_id"), F.lit(1 << 32)) / float(1 << 32)
    return result(p, texts(), texts(), F.lit("low"), F.lit(0))


@register("family_precedent_v1")
def family_precedent() -> Column:
    """More approvals of the family and of the gene, more chance."""
    family, gene = (F.coalesce(c, F.lit(0.0)).cast("double") for c in ("family_approved_count", "gene_approved_count"))
    p = 0.10 + F.least(F.lit(0.5), F.log1p(F.greatest(F.lit(0.0), family)) * 0.075) + F.least(F.lit(0.2), F.log1p(F.greatest(F.lit(0.0), gene)) * 0.05)
    good = texts(F.when(family >= 2, F.concat(F.lit("family_approved_count="), number(family))), F.when(gene >= 1, F.concat(F.lit("gene_approved_count="), number(gene))))
    bad = texts(F.when((family == 0) & (gene == 0), "no family or gene precedent"))
    return result(F.least(F.lit(0.85), F.greatest(F.lit(0.05), p)), good, bad, F.when(family + gene > 0, "high").otherwise("low"), F.lit(2))


@register("genetic_only_v1")
def genetic_only() -> Column:
    """Points for each kind of genetic support."""
    t, clingen, mendelian, genetic, somatic = (F.col(c) for c in ("nelson_tier", "clingen_n_strong", "mendelian_n", "ot_genetic_max", "ot_somatic_score_max"))
    has_tier = F.coalesce(t, F.lit("")) != ""
    points = F.lit(0.0)
    for name, value in TIER_POINTS.items():
        points = F.when(t == name, value).otherwise(points)
    points = points + F.when(clingen >= 1, 0.6).otherwise(0.0) + F.when(mendelian >= 5, 0.5).when(mendelian >= 1, 0.2).otherwise(0.0) + F.when(genetic >= 0.5, 0.5).when(genetic >= 0.3, 0.3).otherwise(0.0) + F.when(somatic >= 0.3, 0.3).otherwise(0.0)
    used = has_tier.cast("int") + clingen.isNotNull().cast("int") + mendelian.isNotNull().cast("int") + genetic.isNotNull().cast("int") + F.coalesce(somatic >= 0.3, F.lit(False)).cast("int")
    good = texts(
        F.when(t.isin("T4", "T3", "T2", "T1"), F.concat(F.lit("Nelson "), t)), F.when(clingen >= 1, F.concat(F.lit("ClinGen strong/def n="), number(clingen))), F.when(mendelian >= 5, F.concat(F.lit("Mendelian n="), number(mendelian))),
        F.when(genetic >= 0.5, F.concat(F.lit("OT genetic "), two_digits(genetic))), F.when(somatic >= 0.3, F.concat(F.lit("OT somatic "), two_digits(somatic))),
    )
    lacking = texts(F.when(t == "T0", "Nelson T0 (no human genetic support)"))
    bad = F.when((F.size(good) == 0) & (F.size(lacking) == 0), F.array(F.lit("no genetic data available"))).otherwise(lacking)
    return result(sigmoid(points * 0.6 - 1.4), good, bad, confidence(used), used)


@register("nelson_only_v1")
def nelson_only() -> Column:
    """C4: a table by tier."""
    t, p, said = F.col("nelson_tier"), F.lit(0.18), F.lit("unknown")
    for name, (value, text) in TIER_P.items():
        p, said = F.when(t == name, value).otherwise(p), F.when(t == name, text).otherwise(said)
    has = F.coalesce(t, F.lit("")) != ""
    return result(p, F.when(has & (t != "T0"), F.array(said)).otherwise(texts()), F.when(t == "T0", F.array(said)).otherwise(texts()), F.when(has, "high").otherwise("low"), has.cast("int"))


def _strongest(passed: list[tuple[Column, float, str]]) -> Column:
    """Labels of the passed tests, the heaviest first (by weight, then label, descending), five at most."""
    items = F.filter(F.array(*[F.when(c, F.struct(F.lit(abs(w)).alias("w"), F.lit(label).alias("label"))) for c, w, label in passed]), lambda x: x.isNotNull())
    return F.transform(F.slice(F.sort_array(items, asc=False), 1, 5), lambda x: x["label"])


@register("rs_composite_v1")
def rs_composite() -> Column:
    """Sum of the weights of the passed tests."""
    passed = [(F.coalesce(t.flag(), F.lit(False)), w, t.label) for t, w in RS_WEIGHTS]
    points = sum((F.when(c, w).otherwise(0.0) for c, w, _ in passed), F.lit(0.0))
    used = sum((F.col(t.column).isNotNull().cast("int") for t, _ in RS_WEIGHTS), F.lit(0))
    return result(sigmoid(points - 1.0), _strongest([x for x in passed if x[1] > 0.15]), _strongest([x for x in passed if x[1] < -0.15]), confidence(used), used)


@register("rs_product_v1")
def rs_product() -> Column:
    """A base rate times the factors of the passed tests, cut to [0.001, 0.99]."""
    logs = sum((F.when(F.coalesce(t.flag(), F.lit(False)), F.log(F.lit(f))).otherwise(0.0) for t, f in RS_FACTORS), F.lit(0.0))
    used = sum((F.col(t.column).isNotNull().cast("int") for t, _ in RS_FACTORS), F.lit(0))
    return result(F.greatest(F.lit(0.001), F.least(F.lit(0.99), 0.05 * F.exp(logs))), texts(), texts(), confidence(used), used)


def score(cohort: DataFrame, name: str, label: str = "any_approved") -> DataFrame:
    """Predictions of a cohort by a registered scorer: keys, the scorer's output, p, y and the rank (ties by the keys)."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; registered: {sorted(SCORERS)}")
    f, version = SCORERS[name]
    out = cohort.select("target_id", "indication_id", F.coalesce(F.col(label), F.lit(False)).alias("y"), f().alias("r")).select("target_id", "indication_id", "y", "r.*")
    return out.withColumns({"p": F.col("predicted_p_approval"), "scorer": F.lit(name), "version": F.lit(version)})


def with_predicted_rank(predictions: DataFrame) -> DataFrame:
    """Rank from 1 by falling score."""
    return with_rank(predictions, [F.desc("p"), F.asc("target_id"), F.asc("indication_id")], "predicted_rank")


@register("my_external_scorer_v1")
def example_external() -> Column:
    """The example of a scorer from outside. Any Mendelian association adds to its chance: the reference means five or more, but its test binds as `n or (0 >= 5)`, which is kept."""
    p = F.when(F.col("depmap_pan_essential"), 0.05).when(F.coalesce(F.col("mendelian_n"), F.lit(0)) != 0, 0.35).otherwise(0.25)
    return result(p, texts(), texts(), F.lit("medium"), F.lit(5))


def score_batches(cohort: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """A scorer of one's own over batches of rows (pandas)."""
    return cohort.mapInPandas(f, schema)


def external(cohort: DataFrame, scores: DataFrame, label: str = "any_approved") -> DataFrame:
    """Scores from outside (target_id, indication_id, p, row_no) held against the cohort; the last of repeated rows wins."""
    last = scores.groupBy("target_id", "indication_id").agg(F.max_by("p", "row_no").alias("p"))
    return cohort.select("target_id", "indication_id", F.coalesce(F.col(label), F.lit(False)).alias("y")).join(last, ["target_id", "indication_id"])


#: Sections of the prompt and their columns.
PROMPT = {"Genetics": ("nelson_tier", "mendelian_n", "clingen_n_strong", "gwas_n_sig", "ot_genetic_max"), "Mechanism": ("tau_specificity", "n_reactome_pathways", "tractability_sm"), "Cell": ("line_c_lit", "depmap_pan_essential"), "Animal": ("line_d_lit", "ot_animal_model_max"), "Human": ("line_e_lit",), "Safety": ("gnomad_pli", "gnomad_loeuf")}


def prompt_text() -> Column:
    """Evidence as text; null, empty and NaN values are left out, and sections without values too."""
    sections = []
    for title, columns in PROMPT.items():
        items = []
        for c in columns:
            v = F.col(c).cast("string")
            items.append(F.when(v.isNotNull() & (v != "") & (v != "NaN"), F.concat(F.lit(f"  {c}: "), v)))
        body = F.concat_ws("\n", *items)
        sections.append(F.when(body != "", F.concat(F.lit(f"{title}:\n"), body)))
    return F.concat_ws("\n", F.concat(F.lit("Target: "), F.coalesce("symbol", F.lit("?"))), F.concat(F.lit("Indication: "), F.coalesce("indication_name", F.lit("?"))), *sections)


def parsed_reply(reply: Column, default: float = 0.03) -> Column:
    """The probability in a reply that holds a JSON object, cut to [0.001, 0.99]; the default if there is none."""
    raw = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.p_approval")
    return F.greatest(F.lit(0.001), F.least(F.lit(0.99), F.coalesce(raw.try_cast("double"), F.lit(default))))


def stratified_sample(cohort: DataFrame, n: int, label: str = "y", seed: int = 42) -> DataFrame:
    """At most n / 2 rows of each class, by a hash of the keys."""
    order = [F.xxhash64(F.lit(seed), "target_id", "indication_id"), F.col("target_id"), F.col("indication_id")]
    return cohort.where(F.col(label)).orderBy(*order).limit(n // 2).unionByName(cohort.where(~F.col(label)).orderBy(*order).limit(n - n // 2))


def evidence_struct(cohort: DataFrame) -> Column:
    """Evidence nested by category, for a snapshot beside the prediction."""
    groups = {"A_genetics": ("nelson_tier", "mendelian_n", "clingen_n_strong", "gwas_n_sig", "ot_genetic_max", "ot_somatic_score_max"), "B_mechanistic": ("tau_specificity", "n_ppi_partners", "n_reactome_pathways"), "C_cell": ("line_c_lit", "depmap_pan_essential"), "D_animal": ("line_d_lit", "ot_animal_model_max"), "E_pd": ("line_e_lit",), "H_safety": ("gnomad_pli", "gnomad_loeuf"), "I_landscape": ("family_approved_count", "gene_approved_count")}
    return F.struct(*[F.struct(*[F.col(c) for c in cs if c in cohort.columns]).alias(g) for g, cs in groups.items()])
