"""Features, models and cross-validation drivers on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypolake.operators.lineage import cut
from hypolake.operators.relational import with_rank

#: The features by category; what follows from the outcome (numbers of programs, drugs and sponsors, phase, known-drug and overall scores) is left out.
NUMERIC = {
    "A_genetics": ("mendelian_n", "mendelian_n_dominant", "mendelian_n_recessive", "clingen_n_strong", "gwas_n_sig", "ot_genetic_max", "ot_somatic_score_max", "ot_rna_expression_max", "ot_l2g_score_max"),
    "B_mechanistic": ("line_b_lit", "tau_specificity", "sc_tau_specificity", "n_ppi_partners", "n_reactome_pathways", "n_go_biological_process", "n_go_molecular_function", "n_go_cellular_component", "max_tissue_tpm", "n_high_tissues", "sc_max_cell_value", "sc_n_cell_types_expressed"),
    "C_cell": ("line_c_lit", "depmap_n_dep_lineages", "depmap_mean_effect"),
    "D_animal": ("line_d_lit", "ot_animal_model_max", "impc_n_phenotypes", "n_hpo_phenotypes"),
    "E_pd": ("line_e_lit",),
    "H_safety": ("gnomad_pli", "gnomad_loeuf"),
    "I_landscape": ("family_approved_count", "gene_approved_count", "n_causal_diseases", "n_suggestive_diseases", "n_dgidb_drugs"),
}
BOOLEAN = {"B_mechanistic": ("tractability_sm", "tractability_ab", "tractability_protac"), "C_cell": ("depmap_pan_essential",), "A_genetics": ("ot_is_mendelian_any",)}
TIERS, AREAS = ("T0", "T1", "T2", "T3", "T4"), ("oncology", "neuro", "autoimmune", "cv", "metabolic", "rare", "infectious", "other")
#: Features that are counts, and columns that follow from the outcome.
COUNTS = (
    "gwas_n_sig",
    "mendelian_n",
    "mendelian_n_dominant",
    "mendelian_n_recessive",
    "family_approved_count",
    "gene_approved_count",
    "n_causal_diseases",
    "n_suggestive_diseases",
    "n_dgidb_drugs",
    "n_ppi_partners",
    "n_reactome_pathways",
    "n_go_biological_process",
    "n_go_molecular_function",
    "n_go_cellular_component",
    "impc_n_phenotypes",
    "n_hpo_phenotypes",
    "max_tissue_tpm",
    "sc_max_cell_value",
    "sc_n_cell_types_expressed",
    "n_high_tissues",
    "clingen_n_strong",
)
LEAKING = ("n_sponsors", "n_programs", "n_drugs", "max_phase_reached", "ot_known_drug_max", "ot_overall_max")


def feature_names() -> list[str]:
    names = [c for group in NUMERIC.values() for c in group] + [c for group in BOOLEAN.values() for c in group] + [f"nelson_{t}" for t in TIERS] + [f"ta_{a}" for a in AREAS]
    assert not set(LEAKING) & set(names)
    return names


def category_map(tier_in_genetics: bool = True) -> dict[str, list[str]]:
    """Features by category for leave-one-out; the tier counts as genetics or as context."""
    out = {c: [*NUMERIC.get(c, ()), *BOOLEAN.get(c, ())] for c in NUMERIC}
    tiers, areas = [f"nelson_{t}" for t in TIERS], [f"ta_{a}" for a in AREAS]
    out["context"] = areas if tier_in_genetics else [*tiers, *areas]
    if tier_in_genetics:
        out["A_genetics"] += tiers
    return out


def features(cohort: DataFrame, keep: Sequence[str], log: bool = True) -> DataFrame:
    """The columns of feature_names as doubles, null where unknown; counts as log1p with unknown as 0; one-hot tiers and areas (no area: other)."""
    columns = {}
    for c in (c for group in NUMERIC.values() for c in group):
        v = F.col(c).cast("double")
        columns[c] = F.log1p(F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)))) if log and c in COUNTS else v
    for c in (c for group in BOOLEAN.values() for c in group):
        columns[c] = F.col(c).cast("double")
    for t in TIERS:
        columns[f"nelson_{t}"] = F.coalesce((F.col("nelson_tier") == t).cast("double"), F.lit(0.0))
    for a in AREAS:
        columns[f"ta_{a}"] = (F.coalesce("therapeutic_area", F.lit("other")) == a).cast("double")
    return cohort.select(*keep, *[v.alias(k) for k, v in columns.items()])


#: Target families and levels that have a column of their own.
FAMILIES = ("Enzyme", "Kinase", "GPCR", "Nuclear Receptor", "Ion Channel", "Transporter", "Transcription Factor", "Epigenetic")
LEVELS = ("Tclin", "Tchem", "Tbio", "Tdark")


def interactions(df: DataFrame) -> DataFrame:
    """Five features of two, each a mask of 0 or 1 but the last. They are taken from log-scaled features as these stand, so that a bound on a count is one on its logarithm; an unknown value passes no bound, and counts as not essential."""
    passes = lambda c, bound: F.coalesce(F.col(c) > bound, F.lit(False))
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mask = lambda c: c.cast("double")
    return df.withColumns(
        {
            "mendelian_x_tissue_specific": mask(passes("mendelian_n", 4) & passes("sc_tau_specificity", 0.75)),
            "clingen_x_tractable_sm": mask(passes("clingen_n_strong", 0) & passes("tractability_sm", 0.5)),
            "nonessential_x_clingen": (1 - known("depmap_pan_essential")) * mask(passes("clingen_n_strong", 0)),
            "ot_genetic_x_animal": mask(passes("ot_genetic_max", 0.3) & passes("ot_animal_model_max", 0.3)),
            "oncology_x_depmap_deps": known("ta_oncology") * F.log1p(known("depmap_n_dep_lineages")),
        }
    )


def family_features(cohort: DataFrame, keep: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """One-hot families (none: other, which has no column) and levels (none: Tdark), and each family beside strong ClinGen evidence."""
    is_family = lambda f: F.coalesce(F.col("family") == f, F.lit(False))
    strong = F.coalesce(F.col("clingen_n_strong") >= 1, F.lit(False))
    columns = {f"fam_{f}": is_family(f) for f in families}
    columns |= {f"tdl_{t}": F.coalesce("tdl", F.lit("Tdark")) == t for t in LEVELS}
    columns |= {f"{f}_x_clingen": is_family(f) & strong for f in families}
    return cohort.select(*keep, *[c.cast("double").alias(n) for n, c in columns.items()])


class Imputer:
    """L2: medians of the training rows (exact, mean of the two middle values), then mean and population deviation; columns without any value are left out."""

    def __init__(self, names: Sequence[str], scale: bool):
        self.names, self.scale = list(names), scale

    def fit(self, df: DataFrame) -> Imputer:
        got = df.agg(*[F.percentile(c, 0.5).alias(c) for c in self.names]).first()
        self.median = {c: float(got[c]) for c in self.names if got[c] is not None}
        filled = self._filled(df)
        stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in self.median], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.median]).first()
        self.mean = {c: stats[f"m_{c}"] for c in self.median}
        self.deviation = {c: stats[f"s_{c}"] or 1.0 for c in self.median}
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.median.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._filled(df)
        if self.scale:
            out = out.withColumns({c: (F.col(c) - self.mean[c]) / self.deviation[c] for c in self.median})
        return VectorAssembler(inputCols=list(self.median), outputCol="features").transform(out)


def balanced(df: DataFrame) -> tuple[DataFrame, float]:
    """Weights n / (2 n_class), and their sum."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(n.values())
    weight = reduce(lambda w, k: F.when(F.col("label") == k, total / (len(n) * n[k])).otherwise(w), n, F.lit(1.0))
    return df.withColumn("weight", weight), float(total)


Fitted = Callable[[DataFrame], DataFrame]
Maker = Callable[[DataFrame, Sequence[str]], Fitted]


def _fitted(imputer: Imputer, model) -> Fitted:
    return lambda df: model.transform(imputer.transform(df)).withColumn("p", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")


def logistic(c: float = 0.5, weighted: bool = True) -> Maker:
    """L3: L2 logistic regression with strength 1 / (c * weights)."""

    def make(df: DataFrame, names: Sequence[str]) -> Fitted:
        imputer = Imputer(names, scale=True).fit(df)
        rows, total = balanced(df)
        model = LogisticRegression(regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200)
        if weighted:
            model = model.setWeightCol("weight")
        return _fitted(imputer, model.fit(imputer.transform(rows)))

    return make


def forest(trees: int = 200, depth: int = 8, leaf: int = 10, seed: int = 42) -> Maker:
    """Random forest, classes in balance."""

    def make(df: DataFrame, names: Sequence[str]) -> Fitted:
        imputer = Imputer(names, scale=False).fit(df)
        rows, _ = balanced(df)
        return _fitted(imputer, RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="weight", seed=seed).fit(imputer.transform(rows)))

    return make


def boosted(rounds: int = 60, depth: int = 5, step: float = 0.1, seed: int = 42) -> Maker:
    """Gradient-boosted trees of Spark ML, in place of libraries that it has not; L6 is in ``boosting``."""

    def make(df: DataFrame, names: Sequence[str]) -> Fitted:
        imputer = Imputer(names, scale=False).fit(df)
        rows, _ = balanced(df)
        return _fitted(imputer, GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, weightCol="weight", seed=seed).fit(imputer.transform(rows)))

    return make


def isotonic(df: DataFrame, score: str = "p") -> Callable[[DataFrame], DataFrame]:
    """Isotonic calibration of a score, cut to [0, 1]."""
    model = IsotonicRegression(featuresCol=score, labelCol="label").fit(df.select(F.col(score).cast("double").alias(score), F.col("label").cast("double").alias("label")))
    return lambda rows: model.transform(rows).withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def calibrated(base: Maker, folds: int = 3) -> Maker:
    """L4: each fold's model is calibrated on the fold it has not seen; their scores are averaged."""

    def make(df: DataFrame, names: Sequence[str]) -> Fitted:
        parts = stratified_folds(df, folds, name="_inner")
        fitted = []
        for k in range(folds):
            model = base(parts.where(F.col("_inner") != k), names)
            fitted.append((model, isotonic(model(parts.where(F.col("_inner") == k)))))

        def apply(rows: DataFrame) -> DataFrame:
            out = rows
            for i, (model, curve) in enumerate(fitted):
                out = curve(model(out)).withColumnRenamed("p", f"_p{i}")
            return out.withColumn("p", sum((F.col(f"_p{i}") for i in range(folds)), F.lit(0.0)) / folds).drop(*[f"_p{i}" for i in range(folds)])

        return apply

    return make


def stratified_folds(df: DataFrame, k: int = 5, keys: Sequence[str] = ("target_id", "indication_id"), seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds of equal shares of each class, by a hash of the keys. The rows of a class have ranks one after another, so that turns by rank deal them evenly; ranks are numbered range by range. The folds are written once, as every model reads them many times."""
    ranked = with_rank(df, [F.col("label"), F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)], "_turn")
    return cut(ranked.withColumn(name, ((F.col("_turn") - 1) % k).cast("int")).drop("_turn"))


def group_folds(df: DataFrame, group: str = "target_id", k: int = 5, name: str = "fold") -> DataFrame:
    """No group in two folds. Groups are ranked by falling size, range by range, and dealt forth and back, so that two folds differ by the largest group's rows at most, whatever the number of groups; nothing is dealt on the driver. Rows without a group are one group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    turn = (F.col("_turn") - 1) % (2 * k)
    dealt = with_rank(sizes, [F.desc("_n"), F.asc_nulls_first(group)], "_turn").select(F.col(group).alias("_group"), F.least(turn, 2 * k - 1 - turn).cast("int").alias(name))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def out_of_fold(df: DataFrame, maker: Maker, names: Sequence[str], k: int = 5, fold: str = "fold") -> DataFrame:
    """Predictions p of every fold by a model of the others."""
    parts = [maker(df.where(F.col(fold) != i), names)(df.where(F.col(fold) == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def stacked(df: DataFrame, makers: dict[str, Maker], names: Sequence[str], keys: Sequence[str] = ("target_id", "indication_id"), k: int = 5, inner: int = 3, group: str | None = None) -> DataFrame:
    """Base models' out-of-fold scores inside each training part feed a logistic regression; grouped at both levels if a group is named."""
    out = []
    for i in range(k):
        train, test = df.where(F.col("fold") != i), df.where(F.col("fold") == i)
        split = group_folds(train, group, inner, "_f") if group else stratified_folds(train, inner, keys, name="_f")
        level = [out_of_fold(split, m, names, inner, "_f").select(*keys, "label", F.col("p").alias(n)) for n, m in makers.items()]
        train_scores = reduce(lambda a, b: a.join(b.drop("label"), list(keys)), level)
        test_scores = reduce(lambda a, b: a.join(b.drop("label"), list(keys)), [m(train, names)(test).select(*keys, "label", F.col("p").alias(n)) for n, m in makers.items()])
        meta = logistic(1.0, weighted=False)(train_scores, list(makers))
        out.append(meta(test_scores).select(*keys, "label", "p"))
    return reduce(DataFrame.unionByName, out)


def leave_one_category_out(df: DataFrame, maker: Maker, k: int = 5, tier_in_genetics: bool = True) -> dict[str, DataFrame]:
    """Out-of-fold predictions without the columns of each category; the key '' has all."""
    names = feature_names()
    runs = {"": names} | {c: [n for n in names if n not in gone] for c, gone in category_map(tier_in_genetics).items()}
    return {c: out_of_fold(df, maker, used, k) for c, used in runs.items()}


def time_split(df: DataFrame, year: int, at: str = "first_trial_date", least: int = 5) -> tuple[DataFrame, DataFrame] | None:
    """Before and from the year on; None with fewer positives than least on a side."""
    early = F.year(F.coalesce(F.col(at), F.lit("2020-01-01").cast("date"))) < year
    train, test = df.where(early), df.where(~early)
    if min(x.where("label = 1").limit(least).count() for x in (train, test)) < least:
        return None
    return train, test


def per_group(df: DataFrame, group: str, maker: Maker, names: Sequence[str], least: int = 100, positives: int = 10, k: int = 5) -> dict[str, DataFrame]:
    """L13 (and L14, with positives=5): models of one group each, for groups with enough rows of both labels."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()  # a row for each area or modality
    return {r[group]: out_of_fold(stratified_folds(df.where(F.col(group) == r[group]), k), maker, names, k) for r in sizes if r[group] is not None and r["n"] >= least and r["pos"] >= positives and r["n"] - r["pos"] >= positives}


#: The feature that each dimension of relative success stands for.
DIMENSION_FEATURES = {
    "A. Mendelian ≥5": "mendelian_n",
    "A. ClinGen Strong/Def ≥1": "clingen_n_strong",
    "A. GWAS ≥50": "gwas_n_sig",
    "A. OT genetic ≥0.3": "ot_genetic_max",
    "A. OT somatic ≥0.3": "ot_somatic_score_max",
    "B. Reactome pathways ≥5": "n_reactome_pathways",
    "B. PPI hub (≥50 partners)": "n_ppi_partners",
    "B. GO-BP ≥20 terms": "n_go_biological_process",
    "B. Bulk Tau ≥0.75": "tau_specificity",
    "B. SC Tau ≥0.75": "sc_tau_specificity",
    "B. Tractable — small mol": "tractability_sm",
    "B. Tractable — antibody": "tractability_ab",
    "C. Line C lit high (≥2)": "line_c_lit",
    "C. DepMap pan-essential": "depmap_pan_essential",
    "D. Line D lit high (≥2)": "line_d_lit",
    "D. OT animal model ≥0.3": "ot_animal_model_max",
    "D. IMPC ≥3 phenotypes": "impc_n_phenotypes",
    "D. HPO ≥10 phenotypes": "n_hpo_phenotypes",
    "E. Line E lit high (≥2)": "line_e_lit",
    "H. gnomAD pLI ≥0.9": "gnomad_pli",
    "H. gnomAD LOEUF <0.35": "gnomad_loeuf",
    "I. Causal disease pleiotropy ≥3": "n_causal_diseases",
    "I. DGIdb drug precedent ≥5": "n_dgidb_drugs",
}


def coefficients(df: DataFrame, names: Sequence[str], c: float = 0.5, weighted: bool = True) -> DataFrame:
    """Feature, beta (for a standard deviation, as fitted) and beta_original (for one unit of the feature) of L3, uncalibrated. A feature without any value has none."""
    imputer = Imputer(names, scale=True).fit(df)
    rows, total = balanced(df)
    model = LogisticRegression(regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10)
    if weighted:
        model = model.setWeightCol("weight")
    found = model.fit(imputer.transform(rows)).coefficients.toArray()
    out = [(n, float(b), float(b / imputer.deviation[n])) for n, b in zip(imputer.median, found)]  # a row for each feature
    return df.sparkSession.createDataFrame(out, "feature string, beta double, beta_original double")


def feature_agreement(relative: DataFrame, found: DataFrame, least: int = 100, of: dict[str, str] = DIMENSION_FEATURES) -> DataFrame:
    """Each dimension with enough support beside its feature's coefficient, and whether both point the same way."""
    pairs = _pairs(relative, of)
    rows = relative.where((F.col("n_supported") >= least) & F.col("relative_success").isNotNull()).join(pairs, "dimension").join(found, "feature")
    return rows.select("dimension", "feature", "relative_success", "beta", "beta_original", ((F.col("relative_success") > 1) == (F.col("beta") > 0)).alias("agrees"))


def _pairs(like: DataFrame, of: dict[str, str]) -> DataFrame:
    return like.sparkSession.createDataFrame(sorted(of.items()), "dimension string, feature string")


def aligned_share(agreement: DataFrame) -> DataFrame:
    """How many dimensions were compared, and the share that agrees."""
    return agreement.agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.col("agrees").cast("double")), 1).alias("pct_aligned"))


def top_features(found: DataFrame, k: int = 15) -> DataFrame:
    """The k largest and the k smallest coefficients, ties by name; rank counts from 1 on each side."""
    from pyspark.sql import Window

    sides = []
    for side, order in (("positive", F.desc("beta")), ("negative", F.asc("beta"))):
        best = found.orderBy(order, "feature").limit(k)
        sides.append(best.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, "feature")).alias("rank"), "feature", "beta", "beta_original"))  # k rows
    return sides[0].unionByName(sides[1])


def sign_agreement(relative: DataFrame, coefficients: DataFrame, least: int = 100) -> DataFrame:
    """Share of dimensions whose coefficient (by dimension) has the sign of their relative success."""
    rows = relative.where(F.col("n_supported") >= least).join(coefficients, "dimension").withColumn("agrees", (F.col("relative_success") > 1) == (F.col("beta") > 0))
    return aligned_share(rows)


def labelled(cohort: DataFrame, label: str = "y", keep: Sequence[str] = ("target_id", "indication_id")) -> DataFrame:
    """Features with label 0 or 1."""
    return features(cohort.withColumn("label", F.coalesce(F.col(label), F.lit(False)).cast("double")), [*keep, "label"])


def calibrated_scores(df: DataFrame, k: int = 5) -> DataFrame:
    """Scores p of a fixed scorer, each fold calibrated by an isotonic curve of the others."""
    rows = stratified_folds(df, k)
    parts = [isotonic(rows.where(F.col("fold") != i))(rows.where(F.col("fold") == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)
