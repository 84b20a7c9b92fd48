"""Queries of transforms, metrics, scorers, portfolios, models and windows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.functions import text as X
from hypolake.operators.lineage import cut
from hypolake.operators.relational import first_per_key
from hypolake.plans import evidence_tests as T
from hypolake.plans import boosting, etl, metrics, ml, portfolio, scorers
from hypolake.plans import views as V
from hypolake.plans.binding import Entities
from hypolake.sources.sinks import inserted_new, upserted
from hypolake.streaming.events import sessions, windowed_counts

Plan = Callable[[Entities], DataFrame]


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# -- transforms ---------------------------------------------------------------


def names(e: Entities) -> DataFrame:
    """E1, E2, E5, E6, E8, E24 on names of parts."""
    c = F.col("p_name")
    return e.part.select("p_partkey", X.norm(F.concat(F.lit(" "), c, F.lit("-X "))).alias("norm"), X.norm_prefix(c, 5).alias("prefix"), X.symbol_key(F.col("p_brand")).alias("symbol"), X.first_token(F.concat_ws("/", c, "p_type")).alias("first"), X.is_combination(F.concat(c, F.when(F.col("p_size") > 25, " and more").otherwise(""))).alias("combination"), X.modality_group(F.when(F.col("p_size") % 4 == 0, F.lit("Gene therapy")).when(F.col("p_size") % 4 == 1, F.lit("Small molecule")).when(F.col("p_size") % 4 == 2, F.lit("antibody")).otherwise(c)).alias("modality"))


NAMES_SQL = """SELECT p_partkey, regexp_replace(lower(trim(' ' || p_name || '-X ')), '[^a-z0-9]', '', 'g') AS norm, regexp_replace(lower(trim(substr(p_name, 1, 5))), '[^a-z0-9]', '', 'g') AS prefix, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS symbol,
  trim(split_part(p_name || '/' || p_type, '/', 1)) AS first, (p_size > 25 OR contains(lower(p_name), '+') OR contains(lower(p_name), ' and ')) AS combination,
  CASE p_size % 4 WHEN 0 THEN 'genetic' WHEN 1 THEN 'small_molecule' WHEN 2 THEN 'biologic' ELSE CASE WHEN regexp_matches(lower(p_name), 'small|molecule') THEN 'small_molecule' WHEN regexp_matches(lower(p_name), 'antibody|protein|biologic|peptide|mab') THEN 'biologic' WHEN regexp_matches(lower(p_name), 'gene|rna|oligo|antisense') THEN 'genetic' WHEN contains(lower(p_name), 'cell') THEN 'cell' ELSE 'other' END END AS modality FROM part"""


def parses(e: Entities) -> DataFrame:
    """E9 to E12 on made-up text of orders."""
    k = F.col("o_orderkey")
    day = F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k % 5 == 1, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    flag = F.when(k % 4 == 0, F.lit(" yes ")).when(k % 4 == 1, F.lit("True")).when(k % 4 == 2, F.lit("no")).otherwise(F.lit(None))
    number = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("x"))).otherwise(F.lit(""))
    phase = F.when(k % 4 == 0, "PHASE1|PHASE2").when(k % 4 == 1, "EARLY_PHASE1").when(k % 4 == 2, "PHASE3").otherwise(F.lit(None))
    return e.orders.select("o_orderkey", X.lenient_date(day).alias("day"), X.lenient_bool(flag).alias("flag"), X.lenient_int(number).alias("number"), X.phase_number(phase).alias("phase"))


PARSES_SQL = """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN date_trunc('month', o_orderdate) WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderdate END AS DATE) AS day, o_orderkey % 4 IN (0, 1) AS flag, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS INTEGER) AS number, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS phase FROM orders"""


def exploded_lists(e: Entities) -> DataFrame:
    """Lists are split and exploded with their place."""
    lists = e.part.select("p_partkey", X.split_list(F.concat_ws("|", "p_name", F.lit(" "), F.lit(""), "p_brand")).alias("parts"))
    return lists.select("p_partkey", F.posexplode("parts").alias("place", "part"))


LISTS_SQL = "SELECT p_partkey, 0 AS place, trim(p_name) AS part FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part"


def upsert(e: Entities) -> DataFrame:
    """Nations with a null key upserted by policy."""
    key = F.when(F.col("n_nationkey") % 10 == 3, None).otherwise(F.col("n_nationkey"))
    old = e.nation.where("n_nationkey < 20").select(key.alias("k"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("b"), F.lit("old").alias("c"))
    old = old.where("k is not null or a = 'NATION_3'")
    new = e.nation.where("n_nationkey >= 10 and n_nationkey != 13").select(key.alias("k"), F.col("n_regionkey").alias("r"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("new")).alias("a"), F.lit("new").alias("b"), F.lit("new").alias("c"))
    return upserted(old, new.where("k is not null or r = 3"), ["k", "r"], {"a": "fill", "b": "keep"})


UPSERT_SQL = """WITH n AS (SELECT CASE WHEN n_nationkey % 10 = 3 THEN NULL ELSE n_nationkey END AS k, n_nationkey, n_regionkey AS r, n_name FROM nation),
  o AS (SELECT k, r, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS b, 'old' AS c FROM n WHERE n_nationkey < 20 AND (k IS NOT NULL OR n_name = 'NATION_3')),
  w AS (SELECT k, r, CASE WHEN n_nationkey % 3 = 0 THEN 'new' END AS a, 'new' AS b, 'new' AS c FROM n WHERE n_nationkey >= 10 AND n_nationkey <> 13 AND (k IS NOT NULL OR r = 3))
  SELECT coalesce(o.k, w.k) AS k, coalesce(o.r, w.r) AS r, coalesce(w.a, o.a) AS a, coalesce(o.b, w.b) AS b, coalesce(w.c, o.c) AS c FROM o FULL JOIN w ON o.k IS NOT DISTINCT FROM w.k AND o.r IS NOT DISTINCT FROM w.r"""


def insert_ignore(e: Entities) -> DataFrame:
    """S7."""
    half = e.supplier.where("s_suppkey % 2 = 0").select("s_suppkey", "s_nationkey", F.lit("old").alias("tag"))
    return inserted_new(half, e.supplier.select("s_suppkey", "s_nationkey", F.lit("new").alias("tag")), ["s_suppkey"])


def merge_precedence(e: Entities) -> DataFrame:
    """Names of drugs from three sources in order of trust."""
    s = e.part.select(F.col("p_partkey").cast("string").alias("key"), "p_size", "p_name", "p_type", "p_brand")
    sources = {"approval": s.where("p_size % 5 = 0").select("key", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name")), "bulk": s.where("p_size % 3 = 0").select("key", F.col("p_type").alias("name"), F.col("p_brand").alias("target")), "trial": s.select("key", F.lit("trial").alias("name"))}
    return etl.merged_by_precedence(sources, "key", ["name", "target"])


MERGE_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS key, coalesce(CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 3 = 0 THEN p_type END, 'trial') AS name, CASE WHEN p_size % 3 = 0 THEN p_brand END AS target,
  CASE WHEN p_size % 5 = 0 THEN 'approval' WHEN p_size % 3 = 0 THEN 'bulk' ELSE 'trial' END AS resolved_via FROM part"""


def last_wins(e: Entities) -> DataFrame:
    """The last line of each part."""
    rows = e.lineitem.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), "l_suppkey", "l_quantity")
    return etl.last_wins(first_per_key(rows, ["l_partkey", "row_no"], [F.col("l_suppkey"), F.col("l_quantity")]), ["l_partkey"])


LAST_SQL = "SELECT l_partkey, row_no, l_suppkey, l_quantity FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS row_no, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1"


MODE_SQL = "SELECT target_id, indication_id, modality FROM (SELECT target_id, indication_id, modality, row_number() OVER (PARTITION BY target_id, indication_id ORDER BY (modality IS NULL), count(*) DESC, modality) AS rn FROM program p JOIN drug d ON d.drug_id = p.drug_id JOIN v_drug_target t ON t.drug_id = d.drug_id AND t.role = 'primary' WHERE d.is_placebo IS NOT TRUE GROUP BY target_id, indication_id, modality) WHERE rn = 1"


# -- metrics ------------------------------------------------------------------

_P = "SELECT run_id, row_id, p, y FROM prediction WHERE p IS NOT NULL AND y IS NOT NULL"
AUC_SQL = f"WITH q AS ({_P}) SELECT a.run_id, round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 8) AS auc FROM q a JOIN q b ON a.run_id = b.run_id WHERE a.y AND NOT b.y GROUP BY a.run_id"
BRIER_SQL = f"WITH q AS ({_P}) SELECT run_id, round(avg((CAST(y AS INT) - p) * (CAST(y AS INT) - p)), 8) AS brier FROM q GROUP BY run_id"


def _k(share: float) -> str:
    return f"greatest(1, CAST(round_even({share} * n, 0) AS BIGINT))"


RANKING_SQL = f"""WITH q AS ({_P}), r AS (SELECT run_id, CAST(y AS INT) AS y, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, y DESC) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM q),
  t AS (SELECT run_id, CAST(sum(y) AS DOUBLE) AS pos, max(n) AS n, {', '.join(f'CAST(sum(CASE WHEN i <= {_k(s)} THEN y ELSE 0 END) AS DOUBLE) AS h{j}, max({_k(s)}) AS k{j}' for j, s in enumerate((0.05, 0.1, 0.2, 0.25)))} FROM r GROUP BY run_id)
  SELECT run_id, round(h0 / pos, 8) AS recall_at_5pct, round(h1 / pos, 8) AS recall_at_10pct, round(h2 / pos, 8) AS recall_at_20pct, round(h1 / k1, 8) AS precision_at_10pct, round((h1 / k1) / ((pos - h1) / (n - k1)), 8) AS rs_top_decile, round((h3 / k3) / ((pos - h3) / (n - k3)), 8) AS rs_top_quartile FROM t"""
ECE_SQL = f"WITH q AS ({_P}), b AS (SELECT run_id, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS INT)) AS my FROM q GROUP BY 1, 2) SELECT run_id, round(sum(n * abs(mp - my)) / sum(n), 8) AS ece FROM b GROUP BY run_id"
CALIBRATION_SQL = "SELECT run_id, CAST(floor(p * 10) + 1 AS INT) AS bin, count(*) AS n, round(avg(p), 8) AS mean_predicted, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 8) AS observed_rate, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) - avg(p), 3) AS calibration_gap FROM prediction WHERE p IS NOT NULL GROUP BY 1, 2"


def bootstrap(e: Entities) -> DataFrame:
    """M7 over all rows of each run, 200 resamples."""
    return rounded(metrics.bootstrap_auc(e.prediction, "row_id", ["run_id"]))


def _auc_of_weights(source: str, by: str) -> str:
    """AUC of weighted rows (p, y, w) from the weight of negatives below and beside each score."""
    return f"""(SELECT {by}, sum(pos * (below - neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
      SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p) AS below FROM (
        SELECT {by}, p, CAST(sum(CASE WHEN y THEN w ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y THEN 0 ELSE w END) AS DOUBLE) AS neg FROM {source} GROUP BY {by}, p)) GROUP BY {by})"""


#: Runs with their AUC and the bounds of its interval; draws are numbered and hashed as in metrics.resampled.
_INTERVALS = f"""q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY row_id) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n, 1 AS w FROM ({_P})),
  drawn AS (SELECT q.run_id, rep, ('0x' || substr(md5('42:' || rep || ':' || q.r), 1, 8))::BIGINT % q.n AS r FROM q CROSS JOIN (SELECT unnest(range(200)) AS rep)),
  resample AS (SELECT d.run_id, d.rep, q.p, q.y, 1 AS w FROM drawn d JOIN q ON q.run_id = d.run_id AND q.r = d.r),
  bounds AS (SELECT run_id, list_sort(list(auc)) AS v FROM {_auc_of_weights('resample', 'run_id, rep')} WHERE auc IS NOT NULL GROUP BY run_id),
  intervals AS (SELECT a.run_id, a.auc, v[1 + CAST(floor(len(v) * 0.025) AS INT)] AS lo, v[1 + CAST(floor(len(v) * 0.975) AS INT)] AS hi FROM {_auc_of_weights('q', 'run_id')} a LEFT JOIN bounds b ON b.run_id = a.run_id)"""
BOOTSTRAP_SQL = f"WITH {_INTERVALS} SELECT run_id, round(auc, 8) AS auc, round(lo, 8) AS auc_lo, round(hi, 8) AS auc_hi FROM intervals"


def _leaderboard(m: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rounded metrics of each run, with the interval as text; null if a bound is."""
    # the text is made of decimals, so that trailing zeros stay
    text = lambda c: F.round(c, 3).cast("decimal(10,3)").cast("string")
    return m.select("run_id", "n_pairs", "n_approved", F.round(100.0 * F.col("n_approved") / F.nullif("n_pairs", F.lit(0)), 1).alias("baseline_approval_pct"), F.round("auc", 3).alias("auc"), F.concat(F.lit("["), text(lo), F.lit(", "), text(hi), F.lit("]")).alias("auc_ci"), F.round("brier", 3).alias("brier"), F.round("ece", 3).alias("calib_err"))


def leaderboard(e: Entities) -> DataFrame:
    """V18 with the interval of M7."""
    bounds = metrics.bootstrap_auc(e.prediction, "row_id", ["run_id"]).select("run_id", "auc_lo", "auc_hi")
    return _leaderboard(metrics.all_metrics(e.prediction, ["run_id"]).join(bounds, "run_id", "left"), F.col("auc_lo"), F.col("auc_hi"))


LEADERBOARD_SQL = f"""WITH {_INTERVALS},
  bins AS (SELECT run_id, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS INT)) AS my FROM q GROUP BY 1, 2), gaps AS (SELECT run_id, sum(n * abs(mp - my)) / sum(n) AS ece FROM bins GROUP BY run_id),
  m AS (SELECT run_id, count(*) AS n_pairs, CAST(sum(CAST(y AS INT)) AS BIGINT) AS n_approved, avg((CAST(y AS INT) - p) * (CAST(y AS INT) - p)) AS brier FROM q GROUP BY run_id)
  SELECT m.run_id, n_pairs, n_approved, round(100.0 * n_approved / n_pairs, 1) AS baseline_approval_pct, round(auc, 3) AS auc,
    '[' || CAST(CAST(round(lo, 3) AS DECIMAL(10, 3)) AS VARCHAR) || ', ' || CAST(CAST(round(hi, 3) AS DECIMAL(10, 3)) AS VARCHAR) || ']' AS auc_ci, round(brier, 3) AS brier, round(ece, 3) AS calib_err
  FROM m LEFT JOIN intervals a ON a.run_id = m.run_id LEFT JOIN gaps g ON g.run_id = m.run_id"""


def effect_intervals(e: Entities) -> DataFrame:
    """M8: odds ratios with intervals of the 2 x 2 cells."""
    return rounded(metrics.odds_ratio_intervals(V.effect_sizes(e), ["cohort", "dimension"]))


def _odds_sql(a: str, b: str, c: str, d: str) -> str:
    add = f"CASE WHEN {a} = 0 OR {b} = 0 OR {c} = 0 OR {d} = 0 THEN 0.5 ELSE 0.0 END"
    return f"(({a} + {add}) * ({d} + {add}) / (({b} + {add}) * ({c} + {add})))"


EFFECT_SQL = f"""WITH cells AS (SELECT cohort, dimension, CAST(high_approved AS DOUBLE) AS a, CAST(high_failed AS DOUBLE) AS b, CAST(low_approved AS DOUBLE) AS c, CAST(low_failed AS DOUBLE) AS d, CAST(high_approved + high_failed + low_approved + low_failed AS BIGINT) AS n FROM v_effect_sizes),
  hashes AS (SELECT rep, i, ('0x' || substr(md5('42:' || rep || ':' || i), 1, 8))::BIGINT AS h FROM (SELECT unnest(range((SELECT max(n) FROM cells))) AS i) CROSS JOIN (SELECT unnest(range(500)) AS rep)),
  draws AS (SELECT cohort, dimension, a, b, c, rep, h % n AS x FROM cells JOIN hashes ON i < n WHERE n >= 20),
  counted AS (SELECT cohort, dimension, rep, CAST(count(*) FILTER (WHERE x < a) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE x >= a AND x < a + b) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE x >= a + b AND x < a + b + c) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE x >= a + b + c) AS DOUBLE) AS d FROM draws GROUP BY ALL),
  bounds AS (SELECT cohort, dimension, list_sort(list({_odds_sql('a', 'b', 'c', 'd')})) AS v FROM counted GROUP BY ALL)
  SELECT k.cohort, k.dimension, a AS high_approved, b AS high_failed, c AS low_approved, d AS low_failed, n AS n_covered, round(CASE WHEN n >= 20 THEN {_odds_sql('a', 'b', 'c', 'd')} END, 8) AS odds_ratio,
    round(v[1 + CAST(floor(len(v) * 0.025) AS INT)], 8) AS odds_ratio_lo, round(v[1 + CAST(floor(len(v) * 0.975) AS INT)], 8) AS odds_ratio_hi
  FROM cells k LEFT JOIN bounds l ON l.cohort = k.cohort AND l.dimension = k.dimension"""


def predicted_rank(e: Entities) -> DataFrame:
    """W5 on the predictions of the composite scorer."""
    return rounded(scorers.with_predicted_rank(scorers.score(V.cohort(e), "rs_product_v1")).select("target_id", "indication_id", "p", "predicted_rank"))


# -- scorers ------------------------------------------------------------------


def _scored(name: str) -> Plan:
    return lambda e: rounded(scorers.score(V.cohort(e), name).select("target_id", "indication_id", "p", "predicted_tier", F.array_join("top_supporting_dims", ";").alias("good"), F.array_join("top_concerning_dims", ";").alias("bad"), "score_confidence", "n_features_used"))


def _score_sql(p: str, good: str, bad: str, sure: str, used: str) -> str:
    tier = "CASE WHEN p >= 0.35 THEN 'high' WHEN p >= 0.18 THEN 'medium' ELSE 'low' END"
    return f"SELECT target_id, indication_id, round(CAST(p AS DOUBLE), 8) AS p, {tier} AS predicted_tier, good, bad, CASE WHEN sure IN ('high', 'medium', 'low') THEN sure WHEN n >= 15 THEN 'high' WHEN n >= 8 THEN 'medium' ELSE 'low' END AS score_confidence, CAST(n AS INT) AS n_features_used FROM (SELECT target_id, indication_id, {p} AS p, {good} AS good, {bad} AS bad, {sure} AS sure, {used} AS n FROM v_cohort)"


def _some(tests, sign: int) -> str:
    items = ", ".join(f"CASE WHEN {t.sql()} THEN {{'w': {abs(w)}, 'l': '{t.label}'}} END" for t, w in tests if w * sign > 0.15)
    return f"array_to_string(list_transform(list_reverse_sort(list_filter([{items}], lambda x: x IS NOT NULL))[1:5], lambda x: x.l), ';')"


_USED = lambda tests: " + ".join(f"CAST({t.column} IS NOT NULL AS INT)" for t, _ in tests)
_HAS = "coalesce(nelson_tier, '') <> ''"
SCORER_SQL = {
    "my_external_scorer_v1": _score_sql("CASE WHEN depmap_pan_essential THEN 0.05 WHEN coalesce(mendelian_n, 0) <> 0 THEN 0.35 ELSE 0.25 END", "''", "''", "'medium'", "5"),
    "family_precedent_v1": _score_sql(
        "least(0.85, greatest(0.05, 0.10 + least(0.5, ln(1 + greatest(0, coalesce(family_approved_count, 0))) * 0.075) + least(0.2, ln(1 + greatest(0, coalesce(gene_approved_count, 0))) * 0.05)))",
        "concat_ws(';', CASE WHEN family_approved_count >= 2 THEN 'family_approved_count=' || CAST(CAST(family_approved_count AS BIGINT) AS VARCHAR) END, CASE WHEN gene_approved_count >= 1 THEN 'gene_approved_count=' || CAST(CAST(gene_approved_count AS BIGINT) AS VARCHAR) END)",
        "CASE WHEN coalesce(family_approved_count, 0) = 0 AND coalesce(gene_approved_count, 0) = 0 THEN 'no family or gene precedent' ELSE '' END",
        "CASE WHEN coalesce(family_approved_count, 0) + coalesce(gene_approved_count, 0) > 0 THEN 'high' ELSE 'low' END", "2"),
    "genetic_only_v1": _score_sql(
        "1 / (1 + exp(-(0.6 * (CASE nelson_tier WHEN 'T4' THEN 1.0 WHEN 'T3' THEN 0.7 WHEN 'T2' THEN 0.5 WHEN 'T1' THEN 0.3 WHEN 'T0' THEN -0.2 ELSE 0 END + CASE WHEN clingen_n_strong >= 1 THEN 0.6 ELSE 0 END + CASE WHEN mendelian_n >= 5 THEN 0.5 WHEN mendelian_n >= 1 THEN 0.2 ELSE 0 END + CASE WHEN ot_genetic_max >= 0.5 THEN 0.5 WHEN ot_genetic_max >= 0.3 THEN 0.3 ELSE 0 END + CASE WHEN ot_somatic_score_max >= 0.3 THEN 0.3 ELSE 0 END) - 1.4)))",
        "concat_ws(';', CASE WHEN nelson_tier IN ('T1', 'T2', 'T3', 'T4') THEN 'Nelson ' || nelson_tier END, CASE WHEN clingen_n_strong >= 1 THEN 'ClinGen strong/def n=' || clingen_n_strong END, CASE WHEN mendelian_n >= 5 THEN 'Mendelian n=' || mendelian_n END, CASE WHEN ot_genetic_max >= 0.5 THEN 'OT genetic ' || printf('%.2f', ot_genetic_max) END, CASE WHEN ot_somatic_score_max >= 0.3 THEN 'OT somatic ' || printf('%.2f', ot_somatic_score_max) END)",
        "CASE WHEN nelson_tier = 'T0' THEN 'Nelson T0 (no human genetic support)' WHEN nelson_tier IN ('T1', 'T2', 'T3', 'T4') OR clingen_n_strong >= 1 OR mendelian_n >= 5 OR coalesce(ot_genetic_max >= 0.5, false) OR coalesce(ot_somatic_score_max >= 0.3, false) THEN '' ELSE 'no genetic data available' END",
        "''", f"CAST({_HAS} AS INT) + CAST(clingen_n_strong IS NOT NULL AS INT) + CAST(mendelian_n IS NOT NULL AS INT) + CAST(ot_genetic_max IS NOT NULL AS INT) + CAST(coalesce(ot_somatic_score_max >= 0.3, false) AS INT)"),
    "nelson_only_v1": _score_sql(
        "CASE nelson_tier WHEN 'T4' THEN 0.45 WHEN 'T3' THEN 0.35 WHEN 'T2' THEN 0.28 WHEN 'T1' THEN 0.22 WHEN 'T0' THEN 0.15 ELSE 0.18 END",
        "CASE nelson_tier WHEN 'T4' THEN 'T4 (Mendelian direction-matched)' WHEN 'T3' THEN 'T3 (Mendelian match)' WHEN 'T2' THEN 'T2 (GWAS coding)' WHEN 'T1' THEN 'T1 (GWAS non-coding)' ELSE '' END",
        "CASE nelson_tier WHEN 'T0' THEN 'T0 (no genetic support)' ELSE '' END", f"CASE WHEN {_HAS} THEN 'high' ELSE 'low' END", f"CAST({_HAS} AS INT)"),
    "rs_composite_v1": _score_sql(f"1 / (1 + exp(-({' + '.join(f'CASE WHEN {t.sql()} THEN {w} ELSE 0 END' for t, w in T.RS_WEIGHTS)} - 1.0)))", _some(T.RS_WEIGHTS, 1), _some(T.RS_WEIGHTS, -1), "''", _USED(T.RS_WEIGHTS)),
    "rs_product_v1": _score_sql(f"greatest(0.001, least(0.99, 0.05 * exp({' + '.join(f'CASE WHEN {t.sql()} THEN ln({w}) ELSE 0 END' for t, w in T.RS_FACTORS)})))", "''", "''", "''", _USED(T.RS_FACTORS)),
}


def scorer_metrics(e: Entities) -> DataFrame:
    """M1 to M6 of all registered scorers over one cohort."""
    cohort = cut(V.cohort(e))  # a row for each pair; every scorer reads it
    out = None
    for name in scorers.SCORERS:
        part = scorers.score(cohort, name).select("scorer", "p", "y")
        out = part if out is None else out.unionByName(part)
    return metrics.all_metrics(cut(out), ["scorer"])


# -- models -------------------------------------------------------------------


def _oof(maker, fold) -> Plan:
    def plan(e: Entities) -> DataFrame:
        rows = cut(fold(cut(ml.labelled(V.strict_cohort(e, 1)))))  # a row for each pair; every fit reads it
        scored = cut(ml.out_of_fold(rows, maker, ml.feature_names()).select("label", "p"))
        return metrics.all_metrics(scored.select(F.lit("model").alias("model"), "p", (F.col("label") == 1).alias("y")), ["model"])

    return plan


def _boosted_metrics(e: Entities, scored: DataFrame) -> DataFrame:
    return metrics.all_metrics(e.keep(scored.select(F.lit("model").alias("model"), "p", (F.col("label") == 1).alias("y"))), ["model"])


def boosted_monotone(e: Entities) -> DataFrame:
    """L6, robust: out-of-fold metrics of boosting with monotone constraints over the strict cohort."""
    rows = ml.stratified_folds(ml.labelled(V.strict_cohort(e, 1)))
    return _boosted_metrics(e, boosting.out_of_fold(rows, ml.feature_names()))


def boosted_isotonic(e: Entities) -> DataFrame:
    """L6, isotonic: the same setting without constraints, calibrated on three inner folds."""
    rows = ml.stratified_folds(ml.stratified_folds(ml.labelled(V.strict_cohort(e, 1))), 3, seed=43, name="inner")
    return _boosted_metrics(e, boosting.calibrated_out_of_fold(rows, ml.feature_names(), settings=replace(boosting.ROBUST, signs={})))


def feature_table(e: Entities) -> DataFrame:
    """The features of the strict cohort."""
    return rounded(ml.labelled(V.strict_cohort(e)))


def _feature_sql() -> str:
    columns = []
    for c in (c for group in ml.NUMERIC.values() for c in group):
        columns.append(f"round(ln(1 + greatest(0, coalesce(CAST({c} AS DOUBLE), 0))), 8) AS {c}" if c in ml.COUNTS else f"round(CAST({c} AS DOUBLE), 8) AS {c}")
    columns += [f"CAST(CAST({c} AS INT) AS DOUBLE) AS {c}" for group in ml.BOOLEAN.values() for c in group]
    columns += [f"CASE WHEN nelson_tier = '{t}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nelson_{t}" for t in ml.TIERS] + [f"CASE WHEN coalesce(therapeutic_area, 'other') = '{a}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ta_{a}" for a in ml.AREAS]
    return f"SELECT target_id, indication_id, CAST(CAST(coalesce(y, false) AS INT) AS DOUBLE) AS label, {', '.join(columns)} FROM v_strict_cohort"


def interaction_table(e: Entities) -> DataFrame:
    """Features of two on the strict cohort."""
    rows = ml.interactions(ml.labelled(V.strict_cohort(e)))
    return rounded(rows.select("target_id", "indication_id", "mendelian_x_tissue_specific", "clingen_x_tractable_sm", "nonessential_x_clingen", "ot_genetic_x_animal", "oncology_x_depmap_deps"))


INTERACTION_SQL = """WITH f AS (SELECT target_id, indication_id, ln(1 + greatest(0, coalesce(CAST(mendelian_n AS DOUBLE), 0))) AS mendelian, sc_tau_specificity AS tau, ln(1 + greatest(0, coalesce(CAST(clingen_n_strong AS DOUBLE), 0))) AS clingen,
    CAST(CAST(tractability_sm AS INT) AS DOUBLE) AS small, CAST(CAST(depmap_pan_essential AS INT) AS DOUBLE) AS essential, ot_genetic_max AS genetic, ot_animal_model_max AS animal, coalesce(therapeutic_area, 'other') = 'oncology' AS oncology, CAST(depmap_n_dep_lineages AS DOUBLE) AS lineages FROM v_strict_cohort)
  SELECT target_id, indication_id, CASE WHEN mendelian > 4 AND tau > 0.75 THEN 1.0 ELSE 0.0 END::DOUBLE AS mendelian_x_tissue_specific, CASE WHEN clingen > 0 AND small > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS clingen_x_tractable_sm,
    CASE WHEN clingen > 0 THEN 1 - coalesce(essential, 0) ELSE 0.0 END::DOUBLE AS nonessential_x_clingen, CASE WHEN genetic > 0.3 AND animal > 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS ot_genetic_x_animal,
    round(CASE WHEN oncology THEN ln(1 + coalesce(lineages, 0)) ELSE 0.0 END::DOUBLE, 8) AS oncology_x_depmap_deps FROM f"""

#: Families of the bound tables, in place of the usual ones.
BOUND_FAMILIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def family_table(e: Entities) -> DataFrame:
    """One-hot families and levels, and families beside ClinGen evidence, on the strict cohort."""
    return ml.family_features(V.strict_cohort(e), ["target_id", "indication_id"], BOUND_FAMILIES)


def _family_sql() -> str:
    one = lambda c, n: f'CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE AS "{n}"'
    columns = [one(f"family = '{f}'", f"fam_{f}") for f in BOUND_FAMILIES] + [one(f"coalesce(tdl, 'Tdark') = '{t}'", f"tdl_{t}") for t in ml.LEVELS] + [one(f"family = '{f}' AND clingen_n_strong >= 1", f"{f}_x_clingen") for f in BOUND_FAMILIES]
    return f"SELECT target_id, indication_id, {', '.join(columns)} FROM v_strict_cohort"


# -- windows ------------------------------------------------------------------


def hourly(e: Entities) -> DataFrame:
    """Extension: tumbling windows over events."""
    return windowed_counts(e.events).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


HOURLY_SQL = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def user_sessions(e: Entities) -> DataFrame:
    """Extension: sessions of users, 30 minutes apart at most."""
    return sessions(e.events).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY user_id"""

_BY = ["run_id"]
QUERIES: dict[str, tuple[Plan, str | None]] = {
    "e_names": (names, NAMES_SQL),
    "e_parses": (parses, PARSES_SQL),
    "e_lists": (exploded_lists, LISTS_SQL),
    "e27_last_wins": (last_wins, LAST_SQL),
    "e28_merge_precedence": (merge_precedence, MERGE_SQL),
    "s6_upsert": (upsert, UPSERT_SQL),
    "s7_insert_ignore": (insert_ignore, "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS tag FROM supplier"),
    "a8_mode": (V.pair_modality, MODE_SQL),
    "j17_precedent_as_of": (lambda e: V.with_precedent(V.strict_outcome(e), V.precedent_by_year(e)).select("target_id", "indication_id", "year", "family_approved_before_year", "gene_approved_before_year"), "SELECT s.target_id, s.indication_id, CAST(extract(year FROM coalesce(s.first_trial_date, DATE '2020-01-01')) AS INT) AS year, coalesce(p.family_approved_before_year, 0) AS family_approved_before_year, coalesce(p.gene_approved_before_year, 0) AS gene_approved_before_year FROM v_strict s LEFT JOIN v_precedent p ON p.target_id = s.target_id AND p.year = extract(year FROM coalesce(s.first_trial_date, DATE '2020-01-01'))"),
    "v21_modality_cohort": (lambda e: V.modality_cohort(e).select("target_id", "indication_id", "y", "modality_group"), f"WITH m AS ({MODE_SQL}) SELECT c.target_id, c.indication_id, c.y, CASE WHEN regexp_matches(coalesce(modality, ''), 'small|molecule') THEN 'small_molecule' WHEN regexp_matches(modality, 'antibody|protein|biologic|peptide|mab') THEN 'biologic' WHEN regexp_matches(modality, 'gene|rna|oligo|antisense') THEN 'genetic' WHEN contains(modality, 'cell') THEN 'cell' ELSE 'other' END AS modality_group FROM v_strict_cohort c JOIN m ON m.target_id = c.target_id AND m.indication_id = c.indication_id"),
    "m1_auc": (lambda e: rounded(metrics.auc(e.prediction, _BY)), AUC_SQL),
    "m2_brier": (lambda e: rounded(metrics.brier(e.prediction, _BY)), BRIER_SQL),
    "m3_ranking": (lambda e: rounded(metrics.ranking(e.prediction, _BY)), RANKING_SQL),
    "m3_ranking_tie_neutral": (lambda e: rounded(metrics.ranking(e.prediction, _BY, neutral=True)), None),
    "m6_ece": (lambda e: rounded(metrics.ece(e.prediction, _BY)), ECE_SQL),
    "m7_bootstrap": (bootstrap, BOOTSTRAP_SQL),
    "m7_bootstrap_all_rows": (bootstrap, BOOTSTRAP_SQL),
    "m8_odds_ratio_intervals": (effect_intervals, EFFECT_SQL),
    "v18_leaderboard": (leaderboard, LEADERBOARD_SQL),
    "v18_leaderboard_bootstrap": (leaderboard, LEADERBOARD_SQL),
    "v19_calibration": (lambda e: rounded(metrics.calibration(e.prediction, _BY)), CALIBRATION_SQL),
    "w5_predicted_rank": (predicted_rank, f"SELECT target_id, indication_id, p, row_number() OVER (ORDER BY q DESC, target_id, indication_id) AS predicted_rank FROM (SELECT target_id, indication_id, round(q, 8) AS p, q FROM (SELECT target_id, indication_id, greatest(0.001, least(0.99, 0.05 * exp({' + '.join(f'CASE WHEN {t.sql()} THEN ln({w}) ELSE 0 END' for t, w in T.RS_FACTORS)}))) AS q FROM v_cohort))"),
    "v24_sponsor_success": (portfolio.sponsor_success, "SELECT sponsor_name AS sponsor, count(DISTINCT drug_id) AS n_drugs, count(DISTINCT drug_id) FILTER (WHERE approved_us) AS n_approved, round(100.0 * CAST(count(DISTINCT drug_id) FILTER (WHERE approved_us) AS DOUBLE) / count(DISTINCT drug_id), 1) AS pct, CAST(1 AS BIGINT) AS n_spellings FROM program p JOIN v_program_outcome po ON po.program_id = p.program_id WHERE sponsor_name IS NOT NULL GROUP BY sponsor_name"),
    "v25_originators": (lambda e: portfolio.originators(e), """WITH k AS (SELECT drug_id, CASE WHEN coalesce(is_placebo, false) OR regexp_matches(lower(display_name), 'placebo|vehicle| saline|sham ') THEN NULL WHEN trim(coalesce(chembl_id, '')) <> '' THEN 'CHEMBL:' || chembl_id ELSE 'NAME:' || trim(regexp_replace(regexp_replace(normalized_name, '\\d+mg\\d*', '', 'g'), 'capsule|tablet|injection|softgel|solution|suspension|inhalation', '', 'g')) END AS drug_key FROM drug),
      o AS (SELECT drug_key, arg_min(sponsor_name, (a.drug_id, sponsor_name)) AS owner FROM approval a JOIN k ON k.drug_id = a.drug_id WHERE sponsor_name IS NOT NULL AND drug_key IS NOT NULL GROUP BY drug_key),
      c AS (SELECT drug_key, sponsor_name, count(*) FILTER (WHERE highest_phase >= 2) AS n FROM program p JOIN k ON k.drug_id = p.drug_id WHERE sponsor_name IS NOT NULL AND drug_key IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT drug_key, sum(n) AS total, max(n) AS best, arg_min(sponsor_name, (-n, sponsor_name)) AS leader FROM c GROUP BY drug_key)
      SELECT * FROM (SELECT d.drug_key, coalesce(o.owner, CASE WHEN best >= 2 AND CAST(best AS DOUBLE) / nullif(total, 0) >= 0.5 THEN leader END) AS sponsor, o.owner IS NOT NULL AS approved FROM (SELECT DISTINCT drug_key FROM k WHERE drug_key IS NOT NULL) d LEFT JOIN o ON o.drug_key = d.drug_key LEFT JOIN m ON m.drug_key = d.drug_key) WHERE sponsor IS NOT NULL"""),
    "v25_originator_success": (lambda e: portfolio.originator_success(e, 2), None),
    "c_scorer_metrics": (scorer_metrics, None),
    "c1_random": (_scored("random_v1"), None),
    "l1_features": (feature_table, _feature_sql()),
    "e22_family_one_hot": (family_table, _family_sql()),
    "e23_interactions": (interaction_table, INTERACTION_SQL),
    "l3_logistic_group_folds": (_oof(ml.logistic(0.5), ml.group_folds), None),
    "l5_forest_stratified": (_oof(ml.forest(), ml.stratified_folds), None),
    "l6_boosted_monotone": (boosted_monotone, None),
    "l6_boosted_isotonic": (boosted_isotonic, None),
    "x_hourly_windows": (hourly, HOURLY_SQL),
    "x_sessions": (user_sessions, SESSIONS_SQL),
} | {f"c_{name}": (_scored(name), text) for name, text in SCORER_SQL.items()}
