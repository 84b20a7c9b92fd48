"""From raw rows to entities: indications, drugs, links, programs, evidence and classifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypolake.functions import text as X
from hypolake.operators.relational import first_per_key


def last_wins(df: DataFrame, key: Sequence[str], order: str = "row_no") -> DataFrame:
    """The last row of each key."""
    return first_per_key(df, key, [-F.col(order)])


def indications(trials: DataFrame) -> DataFrame:
    """Distinct conditions of trials (column conditions, separated by |): key, display name, area and up to 20 spellings."""
    rows = trials.select(F.explode(X.split_list(F.col("conditions"))).alias("name")).withColumn("key", X.norm_prefix(F.col("name"))).where("key != ''")
    by = rows.groupBy("key").agg(F.min("name").alias("display_name"), F.slice(F.array_sort(F.collect_set("name")), 1, 20).alias("spellings"))
    return by.withColumn("therapeutic_area", X.therapeutic_area(F.col("display_name"))).withColumnRenamed("key", "normalized_name")


def merged_by_precedence(sources: Mapping[str, DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """For each key and column the value of the first source, in the order given, that has one; resolved_via is the first source that has the key."""
    union = None
    for rank, (name, df) in enumerate(sources.items()):
        rows = df.select(key, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], F.lit(rank).alias("rank"), F.lit(name).alias("source"))
        union = rows if union is None else union.unionByName(rows)
    pick = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("rank", c))).alias(c) for c in columns]
    return union.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(*pick, F.min_by("source", "rank").alias("resolved_via"))


def lookup(rows: DataFrame, names: DataFrame, on: str, value: str, how: str = "inner") -> DataFrame:
    """Ids by name; of names that stand twice the smallest id counts."""
    return rows.join(names.groupBy(on).agg(F.min(value).alias(value)), on, how)


def by_two_names(rows: DataFrame, table: DataFrame, column: str, key: str, *names: str) -> DataFrame:
    """A lookup by either of two names, whatever their case."""
    either = None
    for n in names:
        part = table.select(F.lower(F.trim(n)).alias("_k"), key).where("_k is not null and _k != ''")
        either = part if either is None else either.unionByName(part)
    return rows.withColumn("_k", F.lower(F.trim(column))).join(either.groupBy("_k").agg(F.min(key).alias(key)), "_k", "left").drop("_k")


def drug_targets(rows: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """Links of drugs (drug_id, target: symbols in a list): the symbol in the first place is primary, others secondary; a symbol that is not known is left out, so a drug may have no primary."""
    listed = rows.select("drug_id", F.posexplode(X.symbols(F.col("target"))).alias("place", "symbol_key")).where("symbol_key != ''")
    known = targets.select("target_id", X.symbol_key(F.col("symbol")).alias("symbol_key"))
    return lookup(listed, known, "symbol_key", "target_id").select("drug_id", "target_id", F.when(F.col("place") == 0, "primary").otherwise("secondary").alias("role"), F.lit(source).alias("source")).distinct()


def program_trials(trials: DataFrame) -> DataFrame:
    """A row for each trial, condition and intervention, with keys, phase, status and dates."""
    rows = trials.select("nct_id", X.phase_number(F.col("phase")).alias("phase"), F.upper(F.coalesce("status", F.lit(""))).alias("status"), "lead_sponsor", X.lenient_date(F.col("start_date")).alias("start_date"), X.lenient_date(F.col("completion_date")).alias("completion_date"), X.split_list(F.col("conditions")).alias("cs"), X.split_list(F.col("interventions")).alias("ds"))
    pairs = rows.withColumn("c", F.explode("cs")).withColumn("d", F.explode("ds"))
    return pairs.select("nct_id", X.norm(F.col("d")).alias("drug_key"), X.norm_prefix(F.col("c")).alias("indication_key"), "lead_sponsor", "phase", "status", "start_date", "completion_date").where("drug_key != '' and indication_key != ''").distinct()


def programs(rows: DataFrame) -> DataFrame:
    """Programs (drug, indication, sponsor; a null sponsor is one) with counts of trials by phase and status, and first and last dates. A trial reached by two names of one drug counts once."""
    once = rows.dropDuplicates(["nct_id", "drug_key", "indication_key", "lead_sponsor"])
    n = lambda c: F.count(F.when(c, 1))
    return once.groupBy("drug_key", "indication_key", "lead_sponsor").agg(
        F.count("*").alias("n_trials"), F.max("phase").alias("highest_phase"), *[n(F.col("phase") == k).alias(f"n_trials_ph{k}") for k in (1, 2, 3, 4)], *[n(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("TERMINATED", "WITHDRAWN", "SUSPENDED", "COMPLETED")],
        n(X.is_active(F.col("status"))).alias("n_active"), F.min("start_date").alias("first_trial_date"), F.max(F.coalesce("completion_date", "start_date")).alias("last_trial_date"),
    )


def approvals(rows: DataFrame, region: str = "US") -> DataFrame:
    """Approvals from text columns; a year that is no number is null."""
    flags = ("first_in_class", "orphan", "breakthrough", "accelerated", "fast_track", "priority_review")
    return rows.select(X.norm(F.col("drug_generic")).alias("drug_key"), X.norm_prefix(F.col("indication")).alias("indication_key"), F.concat(F.lit("FDA_"), F.upper(F.coalesce(F.nullif("center", F.lit("")), F.lit("CDER")))).alias("agency"), F.lit(region).alias("region"), X.lenient_int(F.col("year")).alias("approval_year"), "sponsor", *[X.lenient_bool(F.col(f)).alias(f) for f in flags]).where("drug_key != ''")


def approved_elsewhere(approved: DataFrame, us: DataFrame) -> DataFrame:
    """Approved drugs that are not in the US set."""
    return approved.join(us.select("drug_key").distinct(), "drug_key", "left_anti")


def long_evidence(rows: DataFrame, subject: str, subject_type: str, dimensions: Mapping[str, str], source: str, version: str) -> DataFrame:
    """Wide rows to long-form evidence: a row for each named column that is a number; citations are cut to ten."""
    values = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").try_cast("double").alias("value_numeric")) for c, d in dimensions.items()])
    pmids = F.slice(F.col("notable_pmids"), 1, 10) if "notable_pmids" in rows.columns else F.array().cast("array<string>")
    return rows.select(F.col(subject).alias("subject"), F.lit(subject_type).alias("subject_type"), F.explode(values).alias("v"), pmids.alias("citation_pmids"), F.lit(source).alias("source"), F.lit(version).alias("source_version")).select("subject", "subject_type", "v.dimension", "v.value_numeric", "citation_pmids", "source", "source_version").where("value_numeric is not null")


def classifications(rows: DataFrame, key: str, task: str, model: str, version: str = "v1") -> DataFrame:
    """Model outputs as rows; the last of repeated keys wins (row_no)."""
    last = last_wins(rows.where(F.col(key).isNotNull()), [key])
    return last.select(F.col(key).alias("subject_key"), F.lit(task).alias("classifier_task"), F.lit(model).alias("classifier_model"), F.lit(version).alias("version"), F.col("cat").alias("category"), "confidence")
