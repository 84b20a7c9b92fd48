"""Queries of ranking and recalibration metrics, group folds, coefficients and alias tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypolake.functions import sponsors
from hypolake.operators.lineage import cut, shared_path
from hypolake.plans import metrics, ml
from hypolake.plans import views as V
from hypolake.plans.binding import Entities
from hypolake.sources import readers, sinks

Plan = Callable[[Entities], DataFrame]


def mrr_and_slope(e: Entities) -> DataFrame:
    """Mean reciprocal rank of the positives, and the slope and intercept of recalibration, of each run."""
    both = metrics.mrr(e.prediction, ["run_id"]).join(metrics.calibration_slope(e.prediction, ["run_id"]), "run_id", "left")
    return both.withColumns({c: F.round(c, 6) for c in ("mrr", "calibration_intercept", "calibration_slope")})


def _newton_sql(steps: int = 12) -> str:
    """Newton's steps one after another, from (0, 0)."""
    parts = [
        "WITH s AS (SELECT run_id, ln(c / (1 - c)) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS pos "
        "FROM (SELECT run_id, y, least(greatest(p, 0.000001), 0.999999) AS c FROM prediction WHERE p IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2)",
        "i0 AS MATERIALIZED (SELECT DISTINCT run_id, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM s)",
        "r AS (SELECT run_id, avg(1.0 / place) FILTER (WHERE y) AS mrr FROM (SELECT run_id, y, rank() OVER (PARTITION BY run_id ORDER BY p DESC) AS place "
        "FROM prediction WHERE p IS NOT NULL AND y IS NOT NULL) GROUP BY run_id)",
    ]
    for k in range(steps):
        parts.append(
            f"t{k} AS (SELECT s.run_id, a, b, x, n, pos, 1 / (1 + exp(-(a + b * x))) AS q FROM s JOIN i{k} ON i{k}.run_id = s.run_id), "
            f"m{k} AS (SELECT run_id, a, b, sum(n * q * (1 - q)) AS s0, sum(n * q * (1 - q) * x) AS s1, sum(n * q * (1 - q) * x * x) AS s2, "
            f"sum(pos - n * q) AS g0, sum((pos - n * q) * x) AS g1 FROM t{k} GROUP BY 1, 2, 3), "
            f"i{k + 1} AS MATERIALIZED (SELECT run_id, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) AS a, b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) AS b FROM m{k})"
        )
    return (
        ", ".join(parts) + " SELECT r.run_id, round(mrr, 6) AS mrr, CASE WHEN ok THEN round(a, 6) END AS calibration_intercept, CASE WHEN ok THEN round(b, 6) END AS calibration_slope "
        f"FROM r LEFT JOIN (SELECT i.*, coalesce(isfinite(i.b) AND abs(i.b - j.b) < 0.00001, false) AS ok FROM i{steps} i JOIN i{steps - 1} j ON j.run_id = i.run_id) i ON i.run_id = r.run_id"
    )


def group_folds(e: Entities) -> DataFrame:
    """The fold of each target of the strict cohort, and its rows."""
    cohort = e.keep(V.strict_cohort(e).select("target_id"))  # read for the sizes and again for the folds
    rows = ml.group_folds(cohort, "target_id", 5)
    return rows.groupBy("target_id", "fold").agg(F.count("*").alias("n_rows"))


GROUP_FOLDS_SQL = """WITH s AS (SELECT target_id, count(*) AS n FROM v_strict_cohort GROUP BY target_id),
  r AS (SELECT target_id, n, row_number() OVER (ORDER BY n DESC, target_id) - 1 AS t FROM s)
  SELECT target_id, CAST(least(t % 10, 9 - t % 10) AS INT) AS fold, n AS n_rows FROM r"""


def feature_coefficients(e: Entities) -> DataFrame:
    """Coefficients of the logistic model over the strict cohort; the cohort is made once, as every step of the fit reads it."""
    rows = cut(ml.labelled(V.strict_cohort(e, 1)))
    return ml.coefficients(rows, ml.feature_names())


def feature_agreement(e: Entities) -> DataFrame:
    """Dimensions of relative success beside the coefficients of their features."""
    return ml.feature_agreement(V.relative_success_clean(e), feature_coefficients(e))


def top_features(e: Entities) -> DataFrame:
    """The fifteen largest and the fifteen smallest coefficients."""
    return ml.top_features(feature_coefficients(e))


#: Names as sponsors write them, made from customers and their nations.
RAW_NAME = """CASE c_custkey % 9
    WHEN 0 THEN c_name || ', a wholly-owned subsidiary of ' || n_name || ' Holdings, Inc.'
    WHEN 1 THEN c_name || ', an affiliate of Group ' || CAST(c_custkey % 40 AS STRING) || ' Pharma Inc. (US)'
    WHEN 2 THEN c_name || ', a ' || n_name || ' company'
    WHEN 3 THEN c_name || ' ' || n_name || ' Holdings GmbH'
    WHEN 4 THEN c_name || ', Inc.'
    WHEN 5 THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name || ' and Company' END
    WHEN 6 THEN ' ' || c_name || ' ' || n_name || ' Co., Ltd.'
    WHEN 7 THEN c_name || ', a healthcare company of Care  Partners'
    ELSE c_name END"""


def canonical_names(e: Entities) -> DataFrame:
    """Canonical names, by a table of aliases made from nations and regions."""
    nations = e.nation.join(e.region, F.col("n_regionkey") == F.col("r_regionkey"))
    short = nations.select(F.lower("n_name").alias("alias"), F.concat(F.lit("Group "), "r_name").alias("canonical"), F.col("n_nationkey").cast("long").alias("position"))
    long = nations.select(F.concat(F.lower("n_name"), F.lit(" holdings")), F.concat(F.lit("Holdings of "), "n_name"), F.col("n_nationkey").cast("long") + 100)
    other = nations.where("n_nationkey = 1").select(F.explode(F.array(F.struct(F.lit("group 1"), F.lit("One"), F.lit(200)), F.struct(F.lit("26"), F.lit("Two"), F.lit(201)))).alias("x")).select("x.*")
    names = e.customer.join(e.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr(RAW_NAME).alias("raw"))
    return sponsors.canonical_names(names, "raw", short.union(long).union(other))


def _canonical_sql() -> str:
    parent = "CASE " + " ".join(f"WHEN regexp_extract(low, '{p}', 1) <> '' THEN trim(regexp_extract(low, '{p}', 1))" for p in sponsors.LINEAGE) + " END"
    suffix = "CASE " + " ".join(f"WHEN ends_with(lower(trim(raw)), '{s}') THEN regexp_replace(left(trim(raw), length(trim(raw)) - {len(s)}), '[,. ]+$', '')" for s in sponsors.SUFFIXES) + " ELSE trim(raw) END"
    title = "array_to_string(list_transform(string_split(regexp_replace(parent, '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ')"
    return f"""WITH names AS (SELECT DISTINCT {RAW_NAME} AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey),
  a AS (SELECT lower(n_name) AS alias, 'Group ' || r_name AS canonical, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT lower(n_name) || ' holdings', 'Holdings of ' || n_name, n_nationkey + 100 FROM nation UNION ALL SELECT 'group 1', 'One', 200 UNION ALL SELECT '26', 'Two', 201),
  p AS (SELECT raw, low, {parent} AS parent FROM (SELECT raw, lower(trim(raw)) AS low FROM names)),
  m AS (SELECT raw, arg_min(canonical, (CASE WHEN parent IS NULL THEN -length(alias) ELSE 0 END, pos)) AS found FROM p JOIN a ON contains(coalesce(parent, low), alias) GROUP BY raw)
  SELECT p.raw, CASE WHEN p.raw = '' THEN 'Unknown' ELSE coalesce(found, {title}, {suffix.replace("raw", "p.raw")}) END AS canonical FROM p LEFT JOIN m ON m.raw = p.raw"""


def audited_ingest(e: Entities) -> DataFrame:
    """Orders as JSON lines, some of them broken, are ingested in one pass: what the table holds, beside the audit row's counts."""
    spark, source, target, log = e.spark, shared_path(e.spark), shared_path(e.spark), shared_path(e.spark)
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    broken = F.when(F.col("o_orderkey") % 97 == 5, F.expr("left(line, length(line) - 4)")).otherwise(F.col("line"))
    e.orders.withColumn("line", line).select(broken.alias("value")).write.text(source)
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double"
    sinks.ingest(readers.json_lines_with_bad(spark, source, schema), target, log, "orders.jsonl", "orders")
    rows = spark.read.parquet(target).where("is_bad = 0").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.crossJoin(spark.read.parquet(log).select("rows_read", "rows_inserted", "rows_skipped"))  # one row


INGEST_SQL = """SELECT o_orderstatus, count(*) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total, (SELECT count(*) FROM orders) AS rows_read,
  (SELECT count(*) FROM orders WHERE o_orderkey % 97 <> 5) AS rows_inserted, (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 5) AS rows_skipped
  FROM orders WHERE o_orderkey % 97 <> 5 GROUP BY o_orderstatus"""


def last_scores(e: Entities) -> DataFrame:
    """Scores from several CSV files with repeated pairs; the last one counts, in order of files and lines."""
    path = shared_path(e.spark)
    rows = e.events.select("event_id", F.col("user_id").alias("target_id"), (F.col("event_id") % 7).alias("indication_id"), F.col("value").alias("predicted_p_approval"))
    ordered = rows.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").drop("event_id")
    ordered.write.csv(path, header=True)
    return readers.last_scores(readers.external_scores(e.spark, path)).withColumn("p", F.round("p", 8))


LAST_SCORES_SQL = "SELECT user_id AS target_id, event_id % 7 AS indication_id, round(CAST(arg_max(value, event_id) AS DOUBLE), 8) AS p FROM events GROUP BY 1, 2"


#: name -> (plan, SQL or None)
QUERIES: dict[str, tuple[Plan, str | None]] = {
    "m11_mrr_and_slope": (mrr_and_slope, _newton_sql()),
    "l9_group_folds": (group_folds, GROUP_FOLDS_SQL),
    "m12_feature_agreement": (feature_agreement, None),
    "m12_top_features": (top_features, None),
    "s9_audited_ingest": (audited_ingest, INGEST_SQL),
    "s11_last_scores": (last_scores, LAST_SCORES_SQL),
    "e25_canonical_names": (canonical_names, _canonical_sql()),
}
