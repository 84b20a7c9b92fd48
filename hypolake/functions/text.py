"""Scalar transforms of names, lists, dates, flags and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Therapeutic areas and their substrings, in the order in which they are tried.
AREAS = {
    "oncology": ("cancer", "carcinoma", "leukemia", "lymphoma", "melanoma", "sarcoma", "tumor", "neoplasm", "myeloma", "glioma", "oncology"),
    "metabolic": ("diabetes", "obesity", "cholesterol", "metabolic", "hyperlipidemia", "glycemic"),
    "autoimmune": ("rheumatoid", "lupus", "psoriasis", "atopic", "crohn", "colitis", "sclerosis", "autoimmune"),
    "neuro": ("alzheimer", "parkinson", "als", "epilepsy", "migraine", "depression", "anxiety", "schizophrenia", "neuropathic", "psychiatr", "neurolog"),
    "cv": ("heart", "cardiac", "hypertens", "stroke", "coronary", "atrial", "fibrillation"),
    "infectious": ("hiv", "hepatitis", "influenza", "covid", "bacter", "sepsis", "malaria", "tuberculosis", "infection"),
    "rare": ("rare", "orphan", "dystrophy", "mendel"),
}
#: Phases of trials by name; other names count as 0.
PHASES = {"PHASE1": 1, "EARLY_PHASE1": 1, "PHASE2": 2, "PHASE3": 3, "PHASE4": 4}
#: Statuses of running trials.
ACTIVE = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION", "NOT_YET_RECRUITING")


def norm(c: Column) -> Column:
    """Lower case, letters and digits only; null gives ''."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]", "")


def norm_prefix(c: Column, n: int = 80) -> Column:
    """Cut before it is normalised."""
    return norm(F.substring(F.coalesce(c, F.lit("")), 1, n))


def split_list(c: Column, pattern: str = r"\|") -> Column:
    """Parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def symbols(c: Column) -> Column:
    """Symbols of a list separated by / , ; or +, with their place; the place of an empty part counts."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), "[/,;+]"), lambda x: symbol_key(x))


def symbol_key(c: Column) -> Column:
    """Letters and digits in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def first_token(c: Column, separator: str = "/") -> Column:
    """E5: what stands before the first separator."""
    return F.trim(F.substring_index(c, separator, 1))


def therapeutic_area(c: Column) -> Column:
    """The first area of which a substring is there."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("other")
    for area, parts in reversed(AREAS.items()):
        out = F.when(low.rlike("|".join(parts)), area).otherwise(out)
    return out


def is_placebo(c: Column) -> Column:
    """E8."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike("placebo|vehicle|saline")


def is_combination(c: Column) -> Column:
    """E8."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return low.contains("+") | low.contains(" and ")


def phase_number(c: Column) -> Column:
    """Combined names such as PHASE1|PHASE2 are not in the table and count as 0."""
    out = F.lit(0)
    for name, n in PHASES.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def is_active(c: Column) -> Column:
    return F.coalesce(c.isin(*ACTIVE), F.lit(False))


def lenient_date(c: Column) -> Column:
    """Year-month-day, or year-month (its first day), else null."""
    return F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)), "yyyy-MM-dd"), F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}"), F.substring(c, 1, 7)), "yyyy-MM"))


def lenient_bool(c: Column) -> Column:
    """E11."""
    return F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("TRUE", "1", "YES", "Y")


def lenient_int(c: Column) -> Column:
    """Null unless the text is a whole number."""
    return F.trim(c).try_cast("int")


def lenient_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def modality_group(c: Column) -> Column:
    """The first group of which a substring is there; 'gene' and 'rna' match inside words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("small|molecule"), "small_molecule").when(low.rlike("antibody|protein|biologic|peptide|mab"), "biologic").when(low.rlike("gene|rna|oligo|antisense"), "genetic").when(low.rlike("cell"), "cell").otherwise("other")


def drug_key(chembl: Column, name: Column, display: Column, placebo: Column) -> Column:
    """CHEMBL:id, else NAME: and the name without doses and forms; null for placebos and controls."""
    control = F.coalesce(placebo, F.lit(False)) | F.lower(F.coalesce(display, F.lit(""))).rlike("placebo|vehicle| saline|sham ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\d+mg\d*", ""), "capsule|tablet|injection|softgel|solution|suspension|inhalation", ""))
    return F.when(control, None).when(F.trim(F.coalesce(chembl, F.lit(""))) != "", F.concat(F.lit("CHEMBL:"), chembl)).when(bare != "", F.concat(F.lit("NAME:"), bare))
