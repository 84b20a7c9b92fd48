"""Operators on small frames: nulls, ties, repeated rows, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hypolake.functions import text as X
from hypolake.functions.sponsors import canonical_sponsor
from hypolake.operators.relational import Test as ThresholdTest
from hypolake.operators.relational import explode_tests, first_per_key, with_exclusive_sum, with_rank
from hypolake.plans import etl, metrics, ml, scorers
from hypolake.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_per_key_breaks_ties_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 3, "n")], "k string, o int, v string")
    assert rows(first_per_key(df, ["k"], [F.col("o"), F.col("v")])) == [("a", 1, "y"), (None, 3, "n")]
    assert rows(first_per_key(df.limit(0), ["k"], [F.col("o")])) == []


def test_explode_tests_drops_unknown_and_keeps_false(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, True), (3, 0.0, False)], "id int, x double, b boolean")
    tests = (ThresholdTest("x", "c", "x", "ge", 1), ThresholdTest("b", "c", "b", "true"))
    got = {(r["id"], r["dimension"], r["supported"]) for r in explode_tests(df, tests, ["id"]).collect()}
    assert got == {(1, "x", True), (2, "b", True), (3, "x", False), (3, "b", False)}


def test_exclusive_sum_leaves_out_the_same_year(spark):
    df = spark.createDataFrame([("k", 2015, 1), ("k", 2016, 2), ("k", 2016, 4), ("k", 2018, 1)], "k string, y int, n int")
    assert [r["s"] for r in with_exclusive_sum(df, ["k"], "y", "n", "s").orderBy("y").collect()] == [0, 1, 1, 7]


def test_global_rank_without_one_partition(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("s"))
    got = with_rank(df, [F.desc("s"), F.asc("id")], "rank", 7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(-r["s"], r["id"]) for r in got] == sorted((-r["s"], r["id"]) for r in got)


def test_upsert_is_idempotent_with_null_keys(spark):
    schema = "k int, j int, a string, b string"
    old = spark.createDataFrame([(1, None, "a", None), (None, 2, "b", "x")], schema)
    new = spark.createDataFrame([(1, None, None, "n"), (None, 2, "c", "y"), (3, 3, "d", "z")], schema)
    once = sinks.upserted(old, new, ["k", "j"], {"a": "fill", "b": "keep"})
    assert rows(once) == rows(sinks.upserted(once, new, ["k", "j"], {"a": "fill", "b": "keep"}))
    assert rows(once) == sorted([(1, None, "a", "n"), (None, 2, "c", "x"), (3, 3, "d", "z")], key=repr)
    with pytest.raises(ValueError):
        sinks.upserted(old, new, ["k", "j"], {"a": "other"})


def test_insert_ignore(spark):
    old, new = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (None, "m")], "k int, v string")
    assert rows(sinks.inserted_new(old, new, ["k"])) == sorted([(1, "a"), (None, "n"), (2, "c")], key=repr)


def test_text_functions(spark):
    cases = spark.createDataFrame([("  A-b C1 ", "2019-03", "yes", "12", "a|b| |c", "PHASE1|PHASE2"), (None, "bad", None, "x", None, "EARLY_PHASE1"), ("", "2019-03-05T00:00", "no", " 7 ", "", None)], "s string, d string, f string, n string, l string, p string")
    got = cases.select(X.norm(F.col("s")), X.lenient_date(F.col("d")), X.lenient_bool(F.col("f")), X.lenient_int(F.col("n")), X.split_list(F.col("l")), X.phase_number(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("abc1", dt.date(2019, 3, 1), True, 12, ["a", "b", "c"], 0), ("", None, False, None, [], 1), ("", dt.date(2019, 3, 5), False, 7, [], 0)]


def test_areas_in_order(spark):
    words = ["Multiple Sclerosis", "ALS", "Breast Cancer", "Type 2 Diabetes", "HIV", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "c string").select(X.therapeutic_area(F.col("c"))).collect()]
    assert got == ["autoimmune", "neuro", "oncology", "metabolic", "infectious", "other", "other"]


def test_sponsors(spark):
    names = ["Genentech, Inc.", "Acme Bio, a subsidiary of Foo Bar Inc.", "Loxo, a Lilly USA company", "Merck Sharp & Dohme LLC", "Tiny Labs, Inc.", "", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(canonical_sponsor(F.col("s"))).collect()]
    assert got == ["Roche / Genentech", "Foo Bar", "Eli Lilly", "Merck (MSD)", "Tiny Labs", "Unknown", "Unknown"]


def test_etl_from_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('nct_id,phase,status,lead_sponsor,conditions,interventions,start_date,completion_date\nN1,PHASE2,COMPLETED,S,"Lupus|Lung Cancer",Drug-A|drug a,2019-03,2020-01-05\nN2,PHASE1|PHASE2,RECRUITING,,Lupus,Drug A,bad,\n')
    schema = "nct_id string, phase string, status string, lead_sponsor string, conditions string, interventions string, start_date string, completion_date string"
    trials = readers.csv(spark, str(tmp_path / "t.csv"), schema)
    got = {(r["indication_key"], r["lead_sponsor"]): r for r in etl.programs(etl.program_trials(trials)).collect()}
    assert set(got) == {("lupus", "S"), ("lungcancer", "S"), ("lupus", None)}
    one = got["lupus", "S"]
    assert (one["n_trials"], one["highest_phase"], one["first_trial_date"], one["last_trial_date"]) == (1, 2, dt.date(2019, 3, 1), dt.date(2020, 1, 5))
    assert got["lupus", None]["n_active"] == 1 and got["lupus", None]["highest_phase"] == 0
    assert {r["normalized_name"]: r["therapeutic_area"] for r in etl.indications(trials).collect()} == {"lupus": "autoimmune", "lungcancer": "oncology"}


def test_json_lines_and_optional_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"gene": "A", "line_b": 2}\n{broken\n{"gene": "B", "line_b": null}\n')
    schema = "gene string, line_b double"
    df = readers.json_lines(spark, str(tmp_path / "x.jsonl"), schema)
    assert rows(etl.long_evidence(df, "gene", "target", {"line_b": "line_b_lit"}, "s", "1").select("subject", "value_numeric")) == [("A", 2.0)]
    assert readers.optional(spark, readers.json_lines, str(tmp_path / "none.jsonl"), schema).count() == 0
    for i in (1, 2):
        (tmp_path / f"tiers_batch_{i}.csv").write_text(f"target,tier\nT{i},T{i}\n")
    assert rows(readers.batches(spark, str(tmp_path / "tiers_batch_*.csv"), "target string, tier string")) == [("T1", "T1", "1"), ("T2", "T2", "2")]


def test_links_and_lookups(spark):
    targets = spark.createDataFrame([(1, "EGFR"), (2, "KRAS"), (3, "kras")], "target_id long, symbol string")
    links = etl.drug_targets(spark.createDataFrame([(7, "EGFR/KRAS"), (8, "zzz; kras"), (9, None)], "drug_id long, target string"), targets, "s")
    assert rows(links) == [(7, 1, "primary", "s"), (7, 2, "secondary", "s"), (8, 2, "secondary", "s")]
    sponsors = spark.createDataFrame([(1, "Acme", "Acme Group"), (2, "Beta", None)], "id long, name string, canonical_name string")
    got = etl.by_two_names(spark.createDataFrame([("ACME GROUP",), ("beta ",), ("x",), (None,)], "s string"), sponsors, "s", "id", "name", "canonical_name")
    assert {(r["s"], r["id"]) for r in got.collect()} == {("ACME GROUP", 1), ("beta ", 2), ("x", None), (None, None)}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 2):
        sinks.swap_in(spark, spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    sinks.log_ingest(spark, str(tmp_path / "log"), "a", "b", 3, 2)
    sinks.log_ingest(spark, str(tmp_path / "log"), "a", "b", None, None, notes="n")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.csv_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    sinks.register_views(spark, {"one": spark.range(1)})
    assert spark.table("one").count() == 1


def slow_auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_is_the_pair_loop(spark):
    r = random.Random(3)
    pairs = [(r.randrange(12) / 11, r.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(pairs, "p double, y boolean")
    got = metrics.auc(df).first()["auc"]
    assert got == pytest.approx(slow_auc(pairs))
    assert metrics.auc(df.withColumn("p", -F.col("p"))).first()["auc"] == pytest.approx(1 - got)
    assert metrics.auc(df.where("y")).first()["auc"] is None


def test_ranking_ties_and_half_even(spark):
    df = spark.createDataFrame([(0.5, i % 5 == 0) for i in range(25)], "p double, y boolean")
    tied = metrics.ranking(df).first()
    assert tied["precision_at_10pct"] == 1.0 and tied["recall_at_10pct"] == pytest.approx(2 / 5)  # 2.5 rows count as 2
    assert metrics.ranking(df, neutral=True).first()["precision_at_10pct_tie_neutral"] == pytest.approx(0.2)


def test_ece_and_calibration_edges(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, False), (0.05, True), (None, True)], "p double, y boolean")
    assert metrics.ece(df).first()["ece"] == pytest.approx(2 / 3 * abs(0.5 - 0.025))
    assert {r["bin"] for r in metrics.calibration(df).collect()} == {1, 11}


def test_odds_ratio_with_an_empty_cell(spark):
    cells = spark.createDataFrame([("a", 10, 0, 5, 9), ("b", 1, 1, 1, 1)], "d string, high_approved int, high_failed int, low_approved int, low_failed int")
    got = {r["d"]: r for r in metrics.odds_ratio_intervals(cells, ["d"], reps=50).collect()}
    assert got["a"]["odds_ratio"] == pytest.approx(10.5 * 9.5 / (0.5 * 5.5)) and got["a"]["odds_ratio_lo"] <= got["a"]["odds_ratio_hi"]
    assert got["b"]["odds_ratio"] is None


def test_folds(spark):
    df = spark.range(500).select((F.col("id") % 37).alias("target_id"), F.col("id").alias("indication_id"), (F.col("id") % 5 == 0).cast("double").alias("label"))
    by = ml.stratified_folds(df, 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    assert {(r["n"], r["p"]) for r in by} == {(100, 20.0)}
    unlabelled = df.withColumn("label", F.when(F.col("indication_id") != 7, F.col("label")))
    assert ml.stratified_folds(unlabelled, 5).count() == 500 and ml.stratified_folds(df.limit(0), 5).count() == 0
    groups = ml.group_folds(df, "target_id", 5)
    assert groups.groupBy("target_id").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0 and groups.count() == 500


def test_models_learn_and_calibrate(spark):
    df = spark.range(400).select(F.col("id").alias("target_id"), F.col("id").alias("indication_id"), (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 2) * 2 + F.rand(1)).alias("x"), F.lit(None).cast("double").alias("gone"), F.when(F.col("id") % 3 > 0, F.rand(2)).alias("holes"))
    rows_ = ml.stratified_folds(df, 3)
    for maker in (ml.logistic(0.5), ml.forest(10, 3), ml.calibrated(ml.logistic(1.0))):
        out = ml.out_of_fold(rows_, maker, ["x", "gone", "holes"], 3)
        assert out.count() == 400
        assert metrics.auc(out.select("p", (F.col("label") == 1).alias("y"))).first()["auc"] > 0.95
    out = ml.stacked(rows_, {"a": ml.logistic(0.5), "b": ml.forest(5, 3)}, ["x", "holes"], k=3, inner=2)
    assert out.count() == 400


def test_features_leak_nothing():
    assert len(ml.feature_names()) == 54
    assert sorted(n for c in ml.category_map().values() for n in c) == sorted(ml.feature_names()) == sorted(n for c in ml.category_map(False).values() for n in c)


def test_scorers_and_plugins(spark, data):
    from hypolake.plans import views as V
    from hypolake.plans.binding import Entities

    cohort = V.cohort(Entities(spark, data)).persist()
    for name in scorers.SCORERS:
        assert scorers.score(cohort, name).where("p is null or p < 0 or p > 1").count() == 0
    with pytest.raises(ValueError):
        scorers.score(cohort, "none")
    outside = cohort.select("target_id", "indication_id", F.lit(0.2).alias("p"), F.lit(1).alias("row_no")).unionByName(cohort.select("target_id", "indication_id", F.lit(0.7).alias("p"), F.lit(2).alias("row_no")))
    assert {r["p"] for r in scorers.external(cohort, outside).select("p").distinct().collect()} == {0.7}

    def constant(batches):
        for b in batches:
            yield b[["target_id", "indication_id"]].assign(p=0.5)

    assert scorers.score_batches(cohort.select("target_id", "indication_id"), constant, "target_id long, indication_id long, p double").count() == cohort.count()
    text = cohort.select(scorers.prompt_text().alias("t")).first()["t"]
    assert text.startswith("Target: ") and "NaN" not in text
    replies = spark.createDataFrame([('x {"p_approval": 0.4} y',), ("none",), ('{"p_approval": 7}',)], "r string")
    assert [r[0] for r in replies.select(scorers.parsed_reply(F.col("r"))).collect()] == [0.4, 0.03, 0.99]
    assert scorers.stratified_sample(cohort.withColumn("y", F.col("any_approved")), 10).count() <= 10
    assert cohort.select(scorers.evidence_struct(cohort).alias("s")).first()["s"]["E_pd"] is not None


def test_stream_of_events(spark, data, tmp_path):
    from hypolake.streaming.events import upsert_stream, windowed_counts

    source = tmp_path / "in"
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    target = str(tmp_path / "latest")
    for _ in range(2):  # a second run finds nothing new
        upsert_stream(spark, stream.select("user_id", "event_id", "value"), target, str(tmp_path / "cp"), ["user_id"], "event_id").awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == events.select("user_id").distinct().count()
    query = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_splits_groups_and_calibration(spark):
    import datetime

    df = spark.range(300).select((F.col("id") % 30).alias("target_id"), F.col("id").alias("indication_id"), (F.col("id") % 3 == 0).cast("double").alias("label"), ((F.col("id") % 3 == 0).cast("double") * 0.4 + F.rand(5) * 0.5).alias("p"), F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise("b").alias("area"), F.when(F.col("id") % 7 > 0, F.expr("make_date(2015 + cast(id % 8 as int), 1, 1)")).alias("first_trial_date"))
    out = ml.calibrated_scores(df)
    assert out.count() == 300 and out.where("p < 0 or p > 1").count() == 0
    assert metrics.ece(out.select("p", (F.col("label") == 1).alias("y"))).first()["ece"] < 0.1
    train, test = ml.time_split(df, 2019)
    assert train.agg(F.max("first_trial_date")).first()[0] < datetime.date(2019, 1, 1) and train.count() + test.count() == 300
    assert train.where("first_trial_date is null").count() == 0 and ml.time_split(df, 2000) is None
    groups = ml.per_group(df.withColumnRenamed("p", "x"), "area", ml.logistic(0.5), ["x"], k=2)
    assert {k: v.count() for k, v in groups.items()} == {"a": 150, "b": 150}
    assert ml.per_group(df, "area", ml.logistic(0.5), ["p"], least=151) == {}


def test_sign_agreement_and_interactions(spark):
    rs = spark.createDataFrame([("a", 200, 1.5), ("b", 200, 0.5), ("c", 200, 2.0), ("d", 50, 2.0)], "dimension string, n_supported long, relative_success double")
    beta = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", -0.5), ("d", 1.0)], "dimension string, beta double")
    assert tuple(ml.sign_agreement(rs, beta).first()) == (3, 66.7)
    names = "mendelian_n double, sc_tau_specificity double, clingen_n_strong double, tractability_sm double, depmap_pan_essential double, ot_genetic_max double, ot_animal_model_max double, ta_oncology double, depmap_n_dep_lineages double"
    rows = [(4.5, 0.8, 1.0, 1.0, 0.0, 0.31, 0.4, 1.0, 3.0), (3.9, 0.8, 0.7, 0.0, 1.0, 0.3, 0.4, 0.0, 3.0), (None,) * 9]
    got = [tuple(r)[9:] for r in ml.interactions(spark.createDataFrame(rows, names)).collect()]
    assert got[0] == (1.0, 1.0, 1.0, 1.0, pytest.approx(1.3862943611)) and got[1] == (0.0, 0.0, 0.0, 0.0, 0.0) == got[2]
    cohort = spark.createDataFrame([(1, "Kinase", "Tclin", 1), (2, None, None, 3), (3, "GPCR", "Tbio", 0)], "id long, family string, tdl string, clingen_n_strong long")
    got = {r["id"]: r.asDict() for r in ml.family_features(cohort, ["id"]).collect()}
    assert {k for k, v in got[1].items() if v == 1.0 and k != "id"} == {"fam_Kinase", "tdl_Tclin", "Kinase_x_clingen"}
    assert {k for k, v in got[2].items() if v == 1.0} == {"tdl_Tdark"} and {k for k, v in got[3].items() if v == 1.0} == {"fam_GPCR", "tdl_Tbio"}


def test_leave_one_category_out(spark):
    names = ml.feature_names()
    df = spark.range(120).select(F.col("id").alias("target_id"), F.col("id").alias("indication_id"), (F.col("id") % 2).cast("double").alias("label"), *[((F.col("id") % 2) + F.rand(i) if n == "line_e_lit" else F.rand(i)).alias(n) for i, n in enumerate(names)])
    import hypolake.plans.ml as m

    kept, m.category_map = m.category_map, lambda tier_in_genetics=True: {"E_pd": ["line_e_lit"]}
    try:
        runs = m.leave_one_category_out(m.stratified_folds(df, 2), m.forest(10, 3), 2)
    finally:
        m.category_map = kept
    score = {c: metrics.auc(r.select("p", (F.col("label") == 1).alias("y"))).first()["auc"] for c, r in runs.items()}
    assert score[""] > score["E_pd"]


def test_precedent_as_of(spark):
    from hypolake.plans.views import with_precedent

    pairs = spark.createDataFrame([(1, 1, dt.date(2019, 5, 1)), (1, 2, None), (2, 3, dt.date(2001, 1, 1))], "target_id long, indication_id long, first_trial_date date")
    known = spark.createDataFrame([(1, 2019, 3, 1), (1, 2020, 4, 2)], "target_id long, year int, family_approved_before_year long, gene_approved_before_year long")
    got = {r["indication_id"]: (r["year"], r["family_approved_before_year"], r["gene_approved_before_year"]) for r in with_precedent(pairs, known).collect()}
    assert got == {1: (2019, 3, 1), 2: (2020, 4, 2), 3: (2001, 0, 0)}


def test_example_external_scorer(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0, False), (3, 1, False), (4, 9, True)], "target_id long, mendelian_n long, depmap_pan_essential boolean")
    f, _ = scorers.SCORERS["my_external_scorer_v1"]
    got = {r["target_id"]: (r["p"], r["t"]) for r in df.select("target_id", f()["predicted_p_approval"].alias("p"), f()["predicted_tier"].alias("t")).collect()}
    assert got == {1: (0.25, "medium"), 2: (0.25, "medium"), 3: (0.35, "high"), 4: (0.05, "low")}
