"""All queries of the library by name, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolake.evaluation_queries import QUERIES as EVALUATION
from hypolake.more_queries import QUERIES as MORE
from hypolake.plans import questions as Q
from hypolake.plans import views as V
from hypolake.plans.binding import Entities, run
from hypolake.plans.oracle_views import sql

Query = Callable[[SparkSession, str], DataFrame]
Plan = Callable[[Entities], DataFrame]


def _flat_outcome(e: Entities) -> DataFrame:
    reasons = ("efficacy", "safety", "commercial", "enrollment", "planned", "other", "no_text")
    return V.program_outcome(e).select("*", *[F.col(f"failure_reasons.{k}").alias(f"f_{k}") for k in reasons]).drop("failure_reasons")


#: name -> (plan, SQL or None)
VIEWS: dict[str, tuple[Plan, str | None]] = {
    "v1_drug_target": (V.drug_target, "SELECT * FROM v_drug_target"),
    "v2_program_outcome": (_flat_outcome, "SELECT * FROM v_program_outcome"),
    "v3_program_evidence_wide": (lambda e: V.program_evidence_wide(e).drop("failure_reasons"), "SELECT * FROM v_wide"),
    "v4_pathway_wrongness": (V.pathway_wrongness, "SELECT * FROM v_pathway_wrongness"),
    "v5_effect_sizes_2x2": (V.effect_sizes, "SELECT * FROM v_effect_sizes"),
    "v6_failure_taxonomy": (V.failure_taxonomy, "SELECT * FROM v_failure_taxonomy"),
    "v7_outcome_summary": (V.outcome_summary, "SELECT * FROM v_outcome_summary"),
    "v8_drug_coverage": (V.drug_coverage, "SELECT * FROM v_drug_coverage"),
    "v9_target_indication": (V.target_indication, "SELECT * FROM v_ti"),
    "v10_target_evidence_wide": (V.target_evidence_wide, "SELECT * FROM v_target_wide"),
    "v11_relative_success": (V.relative_success, "SELECT * FROM v_relative_success"),
    "v12_combination_evidence": (V.combination_evidence, "SELECT * FROM v_combination"),
    "v13_program_clean": (V.program_clean, "SELECT * FROM v_program_clean"),
    "v14_relative_success_clean": (V.relative_success_clean, "SELECT * FROM v_relative_success_clean"),
    "v15_dimension_coverage": (V.dimension_coverage, "SELECT * FROM v_dimension_coverage"),
    "v16_strict_outcome": (V.strict_outcome, "SELECT * FROM v_strict"),
    "v17_precedent_by_year": (V.precedent_by_year, "SELECT * FROM v_precedent"),
    "v20_cohort": (V.cohort, "SELECT * FROM v_cohort"),
    "v21_strict_cohort": (V.strict_cohort, "SELECT * FROM v_strict_cohort"),
    "v22_derived_dimensions": (
        V.derived_dimensions,
        """SELECT target_a_id AS target_id, 'n_ppi_partners' AS dimension, CAST(count(*) AS DOUBLE) AS value_numeric FROM protein_interactions WHERE combined_score >= 700 GROUP BY 1
        UNION ALL SELECT target_id, 'ot_l2g_score_max', max(l2g_score) FROM target_evidence GROUP BY 1 UNION ALL SELECT target_id, 'ot_somatic_score_max', max(somatic_score) FROM target_evidence GROUP BY 1
        UNION ALL SELECT target_id, 'ot_rna_expression_max', max(rna_expression_score) FROM target_evidence GROUP BY 1 UNION ALL SELECT target_id, 'ot_is_mendelian_any', CAST(bool_or(is_mendelian) AS DOUBLE) FROM target_evidence GROUP BY 1
        UNION ALL SELECT target_id, 'mendelian_n_dominant', CAST(count(*) FILTER (WHERE inheritance ILIKE '%dominant%') AS DOUBLE) FROM mendelian_associations GROUP BY 1
        UNION ALL SELECT target_id, 'mendelian_n_recessive', CAST(count(*) FILTER (WHERE inheritance ILIKE '%recessive%') AS DOUBLE) FROM mendelian_associations GROUP BY 1""",
    ),
    "v23_go_counts": (V.go_counts, "SELECT target_id, " + ", ".join(f"count(DISTINCT g.go_id) FILTER (WHERE namespace = '{n}') AS n_go_{n}" for n in ("biological_process", "molecular_function", "cellular_component")) + " FROM gene_go g JOIN go_terms t ON t.go_id = g.go_id GROUP BY target_id"),
    "a22_cell_specificity": (
        V.cell_specificity,
        """SELECT target_id, count(*) AS sc_n_cell_types_expressed, max(value) AS sc_max_cell_value, arg_min(cell_type, (-value, cell_type)) AS sc_max_cell_type,
        round(CASE WHEN count(*) >= 2 THEN (count(*) - sum(value) / max(value)) / (count(*) - 1) END, 9) AS sc_tau_specificity FROM single_cell_expression WHERE value > 0 GROUP BY target_id""",
    ),
}
VIEWS |= {name: (plan, Q.SQL[name]) for name, plan in Q.QUESTIONS.items()} | MORE | EVALUATION


def _query(plan: Plan) -> Query:
    return lambda spark, folder: run(plan, spark, folder)


def queries() -> dict[str, Query]:
    return {name: _query(plan) for name, (plan, _) in VIEWS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, (_, text) in VIEWS.items() if text}
