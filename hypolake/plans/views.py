"""The business views as composed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.functions.text import modality_group
from hypolake.operators.relational import count_if, distinct_joined_of, explode_tests, first_per_key, percent, pivot_max, ratio, with_exclusive_sum
from hypolake.plans import evidence_tests as T
from hypolake.plans.binding import DRUG_DIMENSIONS, REASONS, TARGET_DIMENSIONS, Entities, shared

#: Sources of drug-target links, best first; unlisted ones come last.
SOURCE_PRIORITY = {"fda_approval": 1, "llm_sonnet_verified": 2, "therapy_targets_public": 3, "chembl_bulk": 4, "llm_sonnet": 5, "llm_haiku": 6}
NUMERIC_DIMENSIONS = tuple(d[0] for d in TARGET_DIMENSIONS)
YEARS = (2015, 2026)


def ranked(column: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


@shared
def drug_target(e: Entities) -> DataFrame:
    """V1: the best target of each drug and role; ties within a source go to the smaller target."""
    t = e.targets.select("target_id", F.col("symbol").alias("target_symbol"), F.col("family").alias("target_family"), F.col("tdl").alias("target_tdl"))
    joined = e.drug_target.join(t, "target_id").select("drug_id", "target_id", "role", "mechanism", "source", "confidence", "target_symbol", "target_family", "target_tdl")
    return first_per_key(joined, ["drug_id", "role"], [ranked(F.col("source"), SOURCE_PRIORITY, 99), F.col("target_id")])


@shared
def primary_target(e: Entities) -> DataFrame:
    return drug_target(e).where("role = 'primary'")


@shared
def best_stop_reason(e: Entities) -> DataFrame:
    """One classification of why a trial stopped, the larger model's first."""
    found = e.classification.where("classifier_task = 'why_stopped'")
    return first_per_key(found.where("subject_type = 'trial'"), ["subject_key"], [F.when(F.col("classifier_model") == "claude-sonnet", 1).otherwise(2), F.col("category")])


#: What outcomes are called, by the strict and by the broad reading.
OUTCOMES = (
    *("approved", "efficacy_fail", "safety_fail", "commercial_fail", "enrollment_fail", "planned_termination", "other_fail"),
    *("in_development", "phase_complete_no_approval", "phase1_complete_no_advance", "unknown"),
)
BROAD_OUTCOMES = (
    *("approved", "efficacy_fail", "safety_fail", "commercial_fail", "enrollment_fail", "planned_termination", "unclassified_termination"),
    *("in_dev", "presumptive_efficacy_fail_ph3", "presumptive_fail_ph2", "phase1_only", "unknown"),
)
OUTCOME = ("outcome", "outcome_broad", "outcome_confidence", "approved_us", "approved_ex_us", "first_approval_id", "failure_reasons")


def program_outcome(e: Entities) -> DataFrame:
    """V2: outcomes of programs from approvals of the drug, reasons of stopped trials, and progress."""
    return programs_with_outcome(e).select("program_id", *OUTCOME)


@shared
def programs_with_outcome(e: Entities) -> DataFrame:
    """Programs with all their columns and those of V2, and whether the drug is approved for the indication (approved_here), for views that need both: programs are made and shuffled once, not joined with themselves."""
    approvals = e.approval.groupBy("drug_id").agg(F.bool_or(F.col("region") == "US").alias("us"), F.bool_or(F.col("region") == "ex_US").alias("ex_us"), F.min("approval_id").alias("first_approval_id"), F.collect_set("indication_id").alias("_for"))
    p = e.judged_program.join(approvals, "drug_id", "left")  # dealt by drug, as programs were made
    counts = {k: F.coalesce(F.col(k), F.lit(0)) for k in (*REASONS, "other", "no_text")}
    approved = F.coalesce("us", F.lit(False)) | F.coalesce("ex_us", F.lit(False))
    done, phase = F.col("n_completed") > 0, F.col("highest_phase")

    def ladder(other: str, active: str, *ends: tuple[Column, str]) -> Column:
        steps = [(approved, "approved"), *[(F.col(k) > 0, f"{k}_fail" if k != "planned" else "planned_termination") for k in REASONS], ((F.col("other") > 0) | (F.col("no_text") > 0), other), (F.col("n_active") > 0, active), *ends]
        out = F.lit("unknown")
        for when, then in reversed(steps):
            out = F.when(when, then).otherwise(out)
        return out

    confidence = F.when(approved, "high").when((F.col("efficacy") > 0) | (F.col("safety") > 0), "high").when((F.col("commercial") > 0) | (F.col("enrollment") > 0), "medium").when(done & (phase >= 3), "medium").otherwise("low")
    return p.select(
        *e.program.columns,
        ladder("other_fail", "in_development", (done & (phase >= 2), "phase_complete_no_approval"), (done & (phase == 1), "phase1_complete_no_advance")).alias("outcome"),
        ladder("unclassified_termination", "in_dev", (done & (phase >= 3), "presumptive_efficacy_fail_ph3"), (done & (phase == 2), "presumptive_fail_ph2"), (done & (phase == 1), "phase1_only")).alias("outcome_broad"),
        confidence.alias("outcome_confidence"),
        F.coalesce("us", F.lit(False)).alias("approved_us"),
        F.coalesce("ex_us", F.lit(False)).alias("approved_ex_us"),
        "first_approval_id",
        F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]).alias("failure_reasons"),
        F.coalesce(F.array_contains("_for", F.col("indication_id")), F.lit(False)).alias("approved_here"),
    )


@shared
def _clingen(e: Entities) -> DataFrame:
    return e.clingen_validity.groupBy("target_id").agg(count_if(F.col("classification").isin("Definitive", "Strong")).alias("clingen_n_strong"), F.count("*").alias("clingen_n_all"))


@shared
def _mendelian(e: Entities) -> DataFrame:
    return e.mendelian_associations.groupBy("target_id").agg(F.count("*").alias("mendelian_n"))


@shared
def _gwas(e: Entities) -> DataFrame:
    return e.gwas_associations.groupBy("target_id").agg(count_if(F.col("p_value") < 5e-8).alias("gwas_n_sig"))


@shared
def _scores(e: Entities) -> DataFrame:
    names = {"ot_overall_max": "overall_score", "ot_genetic_max": "genetic_score", "ot_animal_model_max": "animal_model_score", "ot_known_drug_max": "known_drug_score"}
    return e.target_evidence.groupBy("target_id").agg(*[F.max(v).alias(k) for k, v in names.items()], F.countDistinct("disease_id").alias("ot_n_diseases"))


@shared
def _genes(e: Entities) -> DataFrame:
    limits = e.gene_constraint.select("target_id", F.col("pli").alias("gnomad_pli"), F.col("loeuf").alias("gnomad_loeuf"))
    essential = e.gene_essentiality.select("target_id", F.col("mean_effect").alias("depmap_mean_effect"), F.col("pan_essential").alias("depmap_pan_essential"), F.col("n_dependent_lineages").alias("depmap_n_dep_lineages"), F.col("most_dependent_lineage").alias("depmap_top_lineage"))
    return e.targets.join(limits, "target_id", "left").join(essential, "target_id", "left")


@shared
def program_evidence_wide(e: Entities) -> DataFrame:
    """V3: one row a program with all evidence; counts of targets without rows stay null."""
    literature = ("line_b_lit", "line_c_lit", "line_d_lit", "line_e_lit", "impc_n_phenotypes", "family_approved_count", "gene_approved_count")
    of = lambda kind: e.evidence_score.where(F.col("subject_type") == kind)
    target = pivot_max(of("target"), ["subject_id"], literature).withColumnRenamed("subject_id", "target_id")
    drug = pivot_max(of("drug"), ["subject_id"], [d[0] for d in DRUG_DIMENSIONS]).withColumnRenamed("subject_id", "drug_id")
    tier = pivot_max(of("target_indication"), ["subject_id", "subject_id2"], ["nelson_tier"], "value_text").withColumnsRenamed({"subject_id": "target_id", "subject_id2": "indication_id"})
    events = e.adverse_events.groupBy("therapy_id").agg(F.count("meddra_id").alias("sider_n_ae"), F.countDistinct("meddra_id").alias("sider_n_uniq_ae"))
    sider = e.drug.select("drug_id", "therapy_id").where("therapy_id is not null").join(events, "therapy_id", "left").select("drug_id", F.coalesce("sider_n_ae", F.lit(0)).alias("sider_n_ae"), F.coalesce("sider_n_uniq_ae", F.lit(0)).alias("sider_n_uniq_ae"))
    genes = _genes(e).select("target_id", "gnomad_pli", "gnomad_loeuf", "depmap_mean_effect", "depmap_pan_essential", "depmap_n_dep_lineages", "depmap_top_lineage", F.col("family").alias("target_family"), F.col("tdl").alias("target_tdl"), "tractability_sm", "tractability_ab", "tractability_protac")
    drugs = e.drug.select("drug_id", F.col("normalized_name").alias("drug_key"), F.col("display_name").alias("drug_name"), "modality", "resolved_via")
    places = e.indication.select("indication_id", F.col("display_name").alias("indication"), "therapeutic_area")
    # everything known of a target is joined once, before programs meet it
    by_target = genes.join(target, "target_id", "left").join(_clingen(e), "target_id", "left").join(_mendelian(e), "target_id", "left").join(_gwas(e), "target_id", "left").join(_scores(e), "target_id", "left")
    own = ("program_id", "drug_id", "indication_id", "sponsor_id", "sponsor_name", "highest_phase", "n_trials", "n_trials_ph2", "n_trials_ph3", "n_completed", "n_terminated")
    programs = programs_with_outcome(e).select(*own, *OUTCOME).drop("first_approval_id")
    # everything known of a drug is joined before programs meet it, so that these, by far the most rows, are dealt once; a target's tiers are one map by indication
    tiers = tier.where("nelson_tier is not null and indication_id is not null").groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("indication_id", "nelson_tier"))).alias("_tiers"))
    by_drug = drugs.join(primary_target(e).select("drug_id", "target_id", "target_symbol"), "drug_id", "left").join(drug, "drug_id", "left").join(sider, "drug_id", "left")
    by_drug = by_drug.join(by_target.join(tiers, "target_id", "full"), "target_id", "left")
    rows = programs.join(by_drug, "drug_id").join(places, "indication_id").withColumn("nelson_tier", F.col("_tiers")[F.col("indication_id")])
    keys = ("drug_id", "target_id", "indication_id")
    parts = (programs, drugs, places, primary_target(e).select("target_symbol"), tier, by_target, drug, sider)
    return rows.select(*keys, *[c for part in parts for c in part.columns if c not in keys])


def pathway_wrongness(e: Entities) -> DataFrame:
    """V4: how often strong evidence still fails from phase 3 on."""
    rows = explode_tests(program_evidence_wide(e).where("highest_phase >= 3 and target_id is not null"), T.WRONGNESS, ["outcome_broad"], "is_high_evidence")
    o, n = F.col("outcome_broad"), F.count("*")
    approved, efficacy, other = count_if(o == "approved"), count_if(o.isin("efficacy_fail", "presumptive_efficacy_fail_ph3")), count_if(o != "approved")
    return rows.groupBy("dimension", "is_high_evidence").agg(
        n.alias("n_total"), approved.alias("n_approved"), efficacy.alias("n_efficacy_fail"), count_if(o == "safety_fail").alias("n_safety_fail"), count_if(o == "commercial_fail").alias("n_commercial_fail"), other.alias("n_any_fail"),
        percent(approved, n).alias("approved_pct"), percent(efficacy, n).alias("efficacy_fail_pct"), percent(other, n).alias("any_fail_pct"),
    )


BROAD = ("approved", "efficacy_fail", "safety_fail", "commercial_fail", "enrollment_fail", "presumptive_efficacy_fail_ph3", "presumptive_fail_ph2")
TIGHT = BROAD[:5]


@shared
def effect_sizes(e: Entities) -> DataFrame:
    """V5: 2 x 2 cells and the odds ratio of each test in two cohorts; null if a cell is empty."""
    wide = program_evidence_wide(e).where(F.col("outcome_broad").isin(*BROAD) & F.col("target_id").isNotNull())
    labelled = F.when(F.col("outcome_broad").isin(*TIGHT), F.array(F.lit("broad"), F.lit("tight"))).otherwise(F.array(F.lit("broad")))
    rows = explode_tests(wide, T.EFFECT_BROAD, ["outcome_broad"], "is_high").withColumn("cohort", F.explode(labelled))
    rows = rows.where((F.col("cohort") == "broad") | F.col("dimension").isin(*[t.label for t in T.EFFECT_TIGHT]))
    high, good = F.col("is_high"), F.col("outcome_broad") == "approved"
    cells = rows.groupBy("cohort", "dimension").agg(count_if(high & good).alias("high_approved"), count_if(high & ~good).alias("high_failed"), count_if(~high & good).alias("low_approved"), count_if(~high & ~good).alias("low_failed"))
    a, b, c, d = (F.col(x).cast("double") for x in ("high_approved", "high_failed", "low_approved", "low_failed"))
    return cells.withColumn("odds_ratio_point", F.round(F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), a * d / F.nullif(b * c, F.lit(0.0))), 2))


def failure_taxonomy(e: Entities) -> DataFrame:
    """V6: reasons of stopped trials and their shares."""
    from pyspark.sql import Window

    by = best_stop_reason(e).groupBy("category").agg(F.count("*").alias("n_trials"), count_if(F.col("confidence") == "high").alias("n_high_confidence"), count_if(F.col("classifier_model") == "claude-sonnet").alias("n_sonnet"))
    return by.withColumn("pct_of_all_classified", percent(F.col("n_trials"), F.sum("n_trials").over(Window.partitionBy())))  # a row for each category


def outcome_summary(e: Entities) -> DataFrame:
    """V7: shares of outcomes."""
    from pyspark.sql import Window

    rows = programs_with_outcome(e)
    by = rows.groupBy("outcome_broad").agg(F.count("*").alias("n_programs"), count_if(F.col("outcome_confidence") == "high").alias("n_high_conf"), F.countDistinct("drug_id").alias("n_unique_drugs"))
    return by.withColumn("pct", percent(F.col("n_programs"), F.sum("n_programs").over(Window.partitionBy())))  # a row for each outcome


def drug_coverage(e: Entities) -> DataFrame:
    """V8: what is known of each drug; each branch is counted before it is joined, so nothing fans out."""
    targets = e.drug_target.groupBy("drug_id").agg(F.countDistinct("target_id").alias("n_targets"))
    programs = programs_with_outcome(e).groupBy("drug_id").agg(F.count("*").alias("n_programs"), F.bool_or("approved_us").alias("approved_us"), F.bool_or("approved_ex_us").alias("approved_ex_us"), F.max("highest_phase").alias("highest_phase_reached"))
    trials = e.program_trial.join(e.program.select("program_id", "drug_id"), "program_id").groupBy("drug_id").agg(F.countDistinct("nct_id").alias("n_trials"))
    out = e.drug.select("drug_id", "normalized_name", "resolved_via").join(targets, "drug_id", "left").join(programs, "drug_id", "left").join(trials, "drug_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_targets", "n_programs", "n_trials")})


@shared
def _ti_rows(e: Entities) -> DataFrame:
    return programs_with_outcome(e).join(primary_target(e).select("drug_id", "target_id"), "drug_id")


def _failed(kind: str) -> Column:
    if kind == "efficacy":
        return F.bool_or((F.col("outcome") == "efficacy_fail") | (F.col("outcome_broad") == "presumptive_efficacy_fail_ph3"))
    return F.bool_or(F.col("outcome") == "safety_fail")


@shared
def target_indication(e: Entities) -> DataFrame:
    """V9: programs rolled up to pairs of target and indication. A program is one row, as a drug has one primary target."""
    by = _ti_rows(e).groupBy("target_id", "indication_id").agg(
        F.count("*").alias("n_programs"), F.countDistinct("drug_id").alias("n_drugs"), F.countDistinct("sponsor_name").alias("n_sponsors"), F.max("highest_phase").alias("max_phase_reached"),
        F.bool_or(F.col("approved_us") | F.col("approved_ex_us")).alias("any_approved"), F.bool_or("approved_us").alias("any_approved_us"), _failed("efficacy").alias("any_efficacy_fail"), _failed("safety").alias("any_safety_fail"),
        distinct_joined_of("outcome", OUTCOMES).alias("outcomes_all"), distinct_joined_of("outcome_broad", BROAD_OUTCOMES).alias("outcomes_broad_all"), F.min("first_trial_date").alias("first_trial_date"), F.max("last_trial_date").alias("last_trial_date"),
    )
    outcome = F.when(F.col("any_approved"), "approved").when(F.col("any_efficacy_fail"), "efficacy_fail").when(F.col("any_safety_fail"), "safety_fail").when(F.col("max_phase_reached") >= 2, "attempted_no_approval").otherwise("other")
    return by.withColumn("ti_outcome", outcome)


@shared
def target_evidence_wide(e: Entities) -> DataFrame:
    """All evidence of each target; counts of targets without rows are 0."""
    scores = e.evidence_score.where("subject_type = 'target'")
    label = F.col("dimension")
    largest = lambda n, v="value_numeric": F.max(F.when(label == n, F.col(v))).alias(n)
    wide = scores.groupBy(F.col("subject_id").alias("target_id")).agg(*[largest(n) for n in NUMERIC_DIMENSIONS], largest("max_tissue_name", "value_text"), F.bool_or(F.when(label == "ot_is_mendelian_any", F.col("value_boolean"))).alias("ot_is_mendelian_any"))
    genes = _genes(e).where("ip_type != 'Genomic'").drop("ip_type", "pathogen_type", "depmap_top_lineage")
    out = genes.join(wide, "target_id", "left").join(_clingen(e).drop("clingen_n_all"), "target_id", "left").join(_mendelian(e), "target_id", "left").join(_gwas(e), "target_id", "left").join(_scores(e).drop("ot_n_diseases"), "target_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("clingen_n_strong", "mendelian_n", "gwas_n_sig")})


def ti_pool(e: Entities, min_phase: int = 2) -> DataFrame:
    return target_indication(e).where(F.col("max_phase_reached") >= min_phase).join(target_evidence_wide(e), "target_id")


def _relative(rows: DataFrame) -> DataFrame:
    s, ok = F.col("supported"), F.col("any_approved")
    by = rows.groupBy("category", "dimension").agg(count_if(s).alias("n_supported"), count_if(~s).alias("n_not_supported"), count_if(s & ok).alias("n_supported_approved"), count_if(~s & ok).alias("n_not_supported_approved"))
    yes, no = (F.col("n_supported_approved"), F.col("n_supported")), (F.col("n_not_supported_approved"), F.col("n_not_supported"))
    return by.withColumns({"supported_pct_approved": percent(*yes), "not_supported_pct_approved": percent(*no), "relative_success": F.round(ratio(*yes) / F.nullif(ratio(*no), F.lit(0.0)), 2)})


@shared
def relative_success(e: Entities) -> DataFrame:
    """P(approved | supported) / P(approved | not supported) for each test, one scan."""
    return _relative(explode_tests(ti_pool(e), T.RELATIVE_SUCCESS, ["any_approved"]))


def combination_evidence(e: Entities) -> DataFrame:
    """Relative success of two tests, alone and together."""
    known = lambda x, y: F.col(x.column).isNotNull() & F.col(y.column).isNotNull()
    items = [F.when(known(x, y), F.struct(F.lit(x.label).alias("ev_a"), F.lit(y.label).alias("ev_b"), x.flag().alias("a"), y.flag().alias("b"))) for x, y in T.COMBINATIONS]
    rows = ti_pool(e).select("any_approved", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("t")).select("any_approved", "t.*")
    a, b, ok = F.col("a"), F.col("b"), F.col("any_approved")
    sides = {"a": a, "not_a": ~a, "b": b, "not_b": ~b, "ab": a & b, "not_ab": ~(a & b)}
    by = rows.groupBy("ev_a", "ev_b").agg(*[count_if(c).alias(f"n_{k}") for k, c in sides.items()], *[count_if(c & ok).alias(f"n_{k}_appr") for k, c in sides.items()])
    rs = lambda k: F.round(ratio(F.col(f"n_{k}_appr"), F.col(f"n_{k}")) / F.nullif(ratio(F.col(f"n_not_{k}_appr"), F.col(f"n_not_{k}")), F.lit(0.0)), 2)
    return by.select("ev_a", "ev_b", "n_a", "n_a_appr", rs("a").alias("rs_a_alone"), "n_b", "n_b_appr", rs("b").alias("rs_b_alone"), "n_ab", "n_ab_appr", rs("ab").alias("rs_combined"), percent(F.col("n_ab_appr"), F.col("n_ab")).alias("combined_approval_pct"))


@shared
def program_clean(e: Entities) -> DataFrame:
    """Programs of drugs that are no placebos, with canonical sponsors."""
    drugs = e.drug.where(~F.col("is_placebo").eqNullSafe(F.lit(True))).select("drug_id", F.col("normalized_name").alias("drug_key"), F.col("display_name").alias("drug_name"), "modality", "resolved_via", "is_placebo", "is_combination")
    sponsors = e.sponsors.select(F.col("id").alias("sponsor_id"), "canonical_name")
    return e.program.join(drugs, "drug_id").join(sponsors, "sponsor_id", "left").withColumn("sponsor_canonical", F.coalesce("canonical_name", "sponsor_name")).withColumnRenamed("sponsor_name", "sponsor_raw").drop("canonical_name")


def relative_success_clean(e: Entities) -> DataFrame:
    """V11 over pairs with a program of a drug that is no placebo, whatever the target's role."""
    drugs = e.drug.where(~F.col("is_placebo").eqNullSafe(F.lit(True))).select("drug_id")
    backed = e.program.select("drug_id", "indication_id").join(drugs, "drug_id", "left_semi").join(drug_target(e).select("drug_id", "target_id"), "drug_id").select("target_id", "indication_id").distinct()
    return _relative(explode_tests(ti_pool(e).join(backed, ["target_id", "indication_id"], "left_semi"), T.RELATIVE_SUCCESS_CLEAN, ["any_approved"]))


def dimension_coverage(e: Entities) -> DataFrame:
    """Coverage and range of every registered dimension."""
    # dealt by subject first: a few files of subjects make many rows, whose distinct ones would fill the tasks that read them
    dealt = e.evidence_score.select("dimension", "subject_id", "value_numeric", "extracted_at").repartition("dimension", "subject_id")
    scores = dealt.groupBy("dimension").agg(F.countDistinct("subject_id").alias("n_subjects_covered"), F.min("value_numeric").alias("min_val"), F.max("value_numeric").alias("max_val"), F.round(F.avg("value_numeric"), 3).alias("mean_val"), F.min("extracted_at").alias("first_extraction"), F.max("extracted_at").alias("last_extraction"))
    return e.evidence_dimension.select("category", "dimension", "description", "data_type", "subject_type").join(scores, "dimension", "left").withColumn("n_subjects_covered", F.coalesce("n_subjects_covered", F.lit(0)))


@shared
def strict_outcome(e: Entities) -> DataFrame:
    """Pairs with the strict label (approved for this indication) beside the loose one."""
    return _ti_rows(e).groupBy("target_id", "indication_id").agg(
        F.count("*").alias("n_programs"), F.countDistinct("sponsor_name").alias("n_sponsors"), F.max("highest_phase").alias("max_phase_reached"), F.min("first_trial_date").alias("first_trial_date"), F.max("last_trial_date").alias("last_trial_date"),
        F.bool_or("approved_here").alias("strict_approved_this_ti"), F.bool_or(F.col("approved_us") | F.col("approved_ex_us")).alias("loose_approved_any_indication"), _failed("efficacy").alias("any_efficacy_fail"), _failed("safety").alias("any_safety_fail"), distinct_joined_of("outcome_broad", BROAD_OUTCOMES).alias("outcomes_broad_all"),
    )


@shared
def precedent_by_year(e: Entities) -> DataFrame:
    """Approvals of a target and of its family before each year; a running sum over years instead of a lookup for each row."""
    families = e.targets.where("family is not null").select("target_id", "family")
    by_target = e.approval.where("approval_year is not null").select("drug_id", "approval_id", "approval_year").join(drug_target(e).select("drug_id", "target_id"), "drug_id")

    def before(rows: DataFrame, key: str, name: str) -> DataFrame:
        counted = rows.groupBy(key, F.col("approval_year").alias("year")).agg(F.countDistinct("approval_id").alias("n"))
        grid = counted.select(key).distinct().select(key, F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[1]))).alias("year"))
        both = counted.withColumn("asked", F.lit(False)).unionByName(grid.withColumn("n", F.lit(0).cast("long")).withColumn("asked", F.lit(True)))
        return with_exclusive_sum(both, [key], "year", "n", name).where("asked").select(key, "year", name)

    family = before(by_target.join(families, "target_id"), "family", "family_approved_before_year")
    gene = before(by_target, "target_id", "gene_approved_before_year")
    out = families.withColumn("year", F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[1])))).join(family, ["family", "year"], "left").join(gene, ["target_id", "year"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("family_approved_before_year", "gene_approved_before_year")})


def latest_tier(e: Entities, source: str | None = None) -> DataFrame:
    """The tier of each pair that was extracted last; without = source leaves one source out."""
    rows = e.evidence_score.where("subject_type = 'target_indication' and dimension = 'nelson_tier'")
    if source:
        rows = rows.where(F.col("source") != source)
    return rows.groupBy(F.col("subject_id").alias("target_id"), F.col("subject_id2").alias("indication_id")).agg(F.max_by("value_text", F.struct("extracted_at", "source")).alias("nelson_tier"))


@shared
def cohort(e: Entities, min_phase: int = 2) -> DataFrame:
    """Pairs for scoring with the loose label. All pairs of an indication with a placebo program are left out."""
    with_placebo = e.program.join(e.drug.where("is_placebo").select("drug_id"), "drug_id", "left_semi").select("indication_id").distinct()
    targets = e.targets.where("coalesce(pathogen_type, '') = ''").select("target_id")
    places = e.indication.select("indication_id", F.col("display_name").alias("indication_name"), "therapeutic_area")
    pairs = target_indication(e).where(F.col("max_phase_reached") >= min_phase).where(~F.col("outcomes_broad_all").startswith("in_dev"))
    return pairs.join(targets, "target_id", "left_semi").join(with_placebo, "indication_id", "left_anti").join(places, "indication_id").join(target_evidence_wide(e), "target_id").join(latest_tier(e), ["target_id", "indication_id"], "left")


def strict_cohort(e: Entities, min_phase: int = 2, without_source: str | None = None) -> DataFrame:
    """Pairs for scoring with the strict label y."""
    targets = e.targets.where("coalesce(pathogen_type, '') = ''").select("target_id")
    places = e.indication.select("indication_id", F.col("display_name").alias("indication_name"), "therapeutic_area")
    pairs = strict_outcome(e).where(F.col("max_phase_reached") >= min_phase).where(~F.col("outcomes_broad_all").startswith("in_dev")).withColumnRenamed("strict_approved_this_ti", "y")
    return pairs.join(targets, "target_id", "left_semi").join(places, "indication_id").join(target_evidence_wide(e), "target_id").join(latest_tier(e, without_source), ["target_id", "indication_id"], "left")


def derived_dimensions(e: Entities) -> DataFrame:
    """Counts and maxima of upstream tables as long-form evidence."""
    as_rows = lambda df, name, value: df.select("target_id", F.lit(name).alias("dimension"), F.col(value).cast("double").alias("value_numeric"))
    ppi = e.protein_interactions.where("combined_score >= 700").groupBy(F.col("target_a_id").alias("target_id")).agg(F.count("*").alias("n"))
    te = e.target_evidence.groupBy("target_id").agg(F.max("l2g_score").alias("l2g"), F.max("somatic_score").alias("somatic"), F.max("rna_expression_score").alias("rna"), F.bool_or("is_mendelian").cast("double").alias("mendelian"))
    inherited = e.mendelian_associations.groupBy("target_id").agg(count_if(F.col("inheritance").ilike("%dominant%")).alias("dominant"), count_if(F.col("inheritance").ilike("%recessive%")).alias("recessive"))
    parts = [as_rows(ppi, "n_ppi_partners", "n"), *[as_rows(te, n, c) for n, c in (("ot_l2g_score_max", "l2g"), ("ot_somatic_score_max", "somatic"), ("ot_rna_expression_max", "rna"), ("ot_is_mendelian_any", "mendelian"))], as_rows(inherited, "mendelian_n_dominant", "dominant"), as_rows(inherited, "mendelian_n_recessive", "recessive")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def go_counts(e: Entities) -> DataFrame:
    """Distinct terms of each namespace."""
    rows = e.gene_go.join(e.go_terms, "go_id")
    return rows.groupBy("target_id").agg(*[F.countDistinct(F.when(F.col("namespace") == n, F.col("go_id"))).alias(f"n_go_{n}") for n in ("biological_process", "molecular_function", "cellular_component")])


def cell_specificity(e: Entities) -> DataFrame:
    """The cell type of the largest value and Yanai's Tau over positive values; null with fewer than two."""
    rows = e.single_cell_expression.where("value > 0").groupBy("target_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("m"), F.min_by("cell_type", F.struct((-F.col("value")).alias("v"), "cell_type")).alias("sc_max_cell_type"))
    return rows.select("target_id", F.col("n").alias("sc_n_cell_types_expressed"), F.col("m").alias("sc_max_cell_value"), "sc_max_cell_type", F.round(F.when(F.col("n") >= 2, (F.col("n") - F.col("s") / F.col("m")) / (F.col("n") - 1)), 9).alias("sc_tau_specificity"))


def with_precedent(pairs: DataFrame, precedent: DataFrame, at: str = "first_trial_date", default_year: int = 2020) -> DataFrame:
    """The precedent of each pair's target as of the year of its first trial; the default year without a date, and 0 where nothing is known."""
    dated = pairs.withColumn("year", F.coalesce(F.year(at), F.lit(default_year)))
    known = precedent.select("target_id", "year", "family_approved_before_year", "gene_approved_before_year")
    return dated.join(known, ["target_id", "year"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("family_approved_before_year", "gene_approved_before_year")})


def pair_modality(e: Entities) -> DataFrame:
    """The most frequent modality among a pair's programs of drugs that are no placebos, ties to the first in order; null if none is known."""
    drugs = e.drug.where(~F.col("is_placebo").eqNullSafe(F.lit(True))).select("drug_id", "modality")
    rows = e.program.select("drug_id", "indication_id").join(drugs, "drug_id").join(primary_target(e).select("drug_id", "target_id"), "drug_id")
    counted = rows.groupBy("target_id", "indication_id", "modality").agg(F.count("*").alias("n"))
    return counted.groupBy("target_id", "indication_id").agg(F.min_by("modality", F.when(F.col("modality").isNotNull(), F.struct((-F.col("n")).alias("n"), "modality"))).alias("modality"))


def modality_cohort(e: Entities, min_phase: int = 2) -> DataFrame:
    """V21 with the group of the pair's most frequent modality."""
    groups = pair_modality(e).select("target_id", "indication_id", modality_group(F.col("modality")).alias("modality_group"))
    return strict_cohort(e, min_phase).join(groups, ["target_id", "indication_id"])
