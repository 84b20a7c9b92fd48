"""Success of sponsors: by all programs, and by originated drugs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypolake.functions.sponsors import ALIASES, Aliases, canonical_sponsor
from hypolake.functions.text import drug_key
from hypolake.operators.relational import count_if, percent
from hypolake.plans import views as V
from hypolake.plans.binding import Entities


def sponsor_success(e: Entities, aliases: Aliases = ALIASES) -> DataFrame:
    """Distinct drugs and approved drugs of each canonical sponsor, and the spellings seen."""
    rows = V.programs_with_outcome(e).where("sponsor_name is not null").withColumn("sponsor", canonical_sponsor(F.col("sponsor_name"), aliases))
    drugs, approved = F.countDistinct("drug_id"), F.countDistinct(F.when(F.col("approved_us"), F.col("drug_id")))
    return rows.groupBy("sponsor").agg(drugs.alias("n_drugs"), approved.alias("n_approved"), percent(approved, drugs).alias("pct"), F.countDistinct("sponsor_name").alias("n_spellings"))


def originators(e: Entities, aliases: Aliases = ALIASES) -> DataFrame:
    """The sponsor of each canonical drug: the approval's, else the one with two or more programs from phase 2 on that make up half of all; approved tells which."""
    keys = e.drug.select("drug_id", drug_key(F.col("chembl_id"), F.col("normalized_name"), F.col("display_name"), F.col("is_placebo")).alias("drug_key")).where("drug_key is not null")
    owned = e.approval.where("sponsor_name is not null").select("drug_id", canonical_sponsor(F.col("sponsor_name"), aliases).alias("sponsor")).where("sponsor != 'Unknown'").join(keys, "drug_id")
    approved = owned.groupBy("drug_key").agg(F.min_by("sponsor", F.struct("drug_id", "sponsor")).alias("owner"))
    late = e.program.where("sponsor_name is not null").join(keys, "drug_id").withColumn("sponsor", canonical_sponsor(F.col("sponsor_name"), aliases)).groupBy("drug_key", "sponsor").agg(count_if(F.col("highest_phase") >= 2).alias("n"))
    most = late.groupBy("drug_key").agg(F.sum("n").alias("total"), F.max("n").alias("best"), F.min_by("sponsor", F.struct((-F.col("n")).alias("n"), "sponsor")).alias("leader"))
    major = F.when((F.col("best") >= 2) & (F.col("best") / F.nullif(F.col("total"), F.lit(0)) >= 0.5), F.col("leader"))
    out = keys.select("drug_key").distinct().join(approved, "drug_key", "left").join(most, "drug_key", "left")
    return out.select("drug_key", F.coalesce("owner", major).alias("sponsor"), F.col("owner").isNotNull().alias("approved")).where("sponsor is not null")


def originator_success(e: Entities, least: int = 15, aliases: Aliases = ALIASES) -> DataFrame:
    """Originated and approved drugs of sponsors with enough of them."""
    by = originators(e, aliases).groupBy("sponsor").agg(F.count("*").alias("n_originated"), count_if(F.col("approved")).alias("n_approved"))
    return by.withColumn("success_pct", percent(F.col("n_approved"), F.col("n_originated"))).where(F.col("n_originated") >= least)
