"""Threshold tests, stated once and used by all views and scorers."""

from __future__ import annotations

from hypolake.operators.relational import Test

#: Labels, thresholds and directions of the tests of evidence.
_T = Test
WRONGNESS = (
    _T("Line C (cell lit) high (≥2)", "", "line_c_lit", "ge", 2),
    _T("Line D (animal lit) high (≥2)", "", "line_d_lit", "ge", 2),
    _T("Line E (human PD) high (≥2)", "", "line_e_lit", "ge", 2),
    _T("ClinGen Strong/Def ≥1", "", "clingen_n_strong", "ge", 1),
    _T("Mendelian ≥5", "", "mendelian_n", "ge", 5),
    _T("OT genetic ≥0.3", "", "ot_genetic_max", "ge", 0.3),
    _T("OT animal model ≥0.3", "", "ot_animal_model_max", "ge", 0.3),
    _T("IMPC ≥3 KO phenotypes", "", "impc_n_phenotypes", "ge", 3),
    _T("DepMap pan-essential", "", "depmap_pan_essential", "true"),
    _T("gnomAD pLI ≥0.9", "", "gnomad_pli", "ge", 0.9),
)
EFFECT_BROAD = (
    _T("Line C lit high (≥2)", "", "line_c_lit", "ge", 2),
    _T("Line D lit high (≥2)", "", "line_d_lit", "ge", 2),
    _T("Line E lit high (≥2)", "", "line_e_lit", "ge", 2),
    _T("ClinGen Strong/Def ≥1", "", "clingen_n_strong", "ge", 1),
    _T("Mendelian ≥5", "", "mendelian_n", "ge", 5),
    _T("OT genetic ≥0.3", "", "ot_genetic_max", "ge", 0.3),
    _T("OT overall ≥0.5", "", "ot_overall_max", "ge", 0.5),
    _T("OT animal model ≥0.3", "", "ot_animal_model_max", "ge", 0.3),
    _T("DepMap pan-essential", "", "depmap_pan_essential", "true"),
    _T("DepMap ≥5 dep lineages", "", "depmap_n_dep_lineages", "ge", 5),
    _T("gnomAD pLI ≥0.9", "", "gnomad_pli", "ge", 0.9),
    _T("gnomAD LOEUF <0.35", "", "gnomad_loeuf", "lt", 0.35),
    _T("IMPC ≥3 phenotypes", "", "impc_n_phenotypes", "ge", 3),
    _T("Tractable — small mol", "", "tractability_sm", "true"),
    _T("Tractable — antibody", "", "tractability_ab", "true"),
)
_TIGHT = ("line_c_lit", "line_d_lit", "line_e_lit", "clingen_n_strong", "mendelian_n", "depmap_pan_essential", "ot_animal_model_max")
EFFECT_TIGHT = tuple(t for t in EFFECT_BROAD if t.column in _TIGHT)
RELATIVE_SUCCESS = (
    _T("A. Rare Mendelian ≥1 dominant", "A_genetics", "mendelian_n_dominant", "ge", 1),
    _T("A. Rare Mendelian ≥1 recessive", "A_genetics", "mendelian_n_recessive", "ge", 1),
    _T("A. Mendelian associations ≥5", "A_genetics", "mendelian_n", "ge", 5),
    _T("A. ClinGen Strong/Definitive ≥1", "A_genetics", "clingen_n_strong", "ge", 1),
    _T("A. GWAS significant ≥50", "A_genetics", "gwas_n_sig", "ge", 50),
    _T("A. OT genetic ≥0.3", "A_genetics", "ot_genetic_max", "ge", 0.3),
    _T("A. OT L2G colocalization ≥0.5", "A_genetics", "ot_l2g_score_max", "ge", 0.5),
    _T("A. OT somatic (cancer) ≥0.3", "A_genetics", "ot_somatic_score_max", "ge", 0.3),
    _T("B. Tractable — small mol", "B_mechanistic", "tractability_sm", "true"),
    _T("B. Tractable — antibody", "B_mechanistic", "tractability_ab", "true"),
    _T("B. Tissue-specific (Tau ≥0.75)", "B_mechanistic", "tau_specificity", "ge", 0.75),
    _T("B. High-expression max_tpm ≥100", "B_mechanistic", "max_tissue_tpm", "ge", 100),
    _T("B. Reactome pathways ≥5", "B_mechanistic", "n_reactome_pathways", "ge", 5),
    _T("B. Hub-like (PPI partners ≥50)", "B_mechanistic", "n_ppi_partners", "ge", 50),
    _T("C. Line C lit high (≥2)", "C_cell", "line_c_lit", "ge", 2),
    _T("C. DepMap pan-essential", "C_cell", "depmap_pan_essential", "true"),
    _T("D. Line D lit high (≥2)", "D_animal", "line_d_lit", "ge", 2),
    _T("D. OT animal model ≥0.3", "D_animal", "ot_animal_model_max", "ge", 0.3),
    _T("D. IMPC ≥3 phenotypes", "D_animal", "impc_n_phenotypes", "ge", 3),
    _T("D. HPO phenotypes ≥10", "D_animal", "n_hpo_phenotypes", "ge", 10),
    _T("E. Line E lit high (≥2)", "E_pd", "line_e_lit", "ge", 2),
    _T("H. gnomAD pLI ≥0.9", "H_safety", "gnomad_pli", "ge", 0.9),
    _T("H. gnomAD LOEUF <0.35", "H_safety", "gnomad_loeuf", "lt", 0.35),
    _T("I. Prior approvals (family ≥2)", "I_landscape", "family_approved_count", "ge", 2),
    _T("I. DGIdb drug precedent ≥5", "I_landscape", "n_dgidb_drugs", "ge", 5),
    _T("I. Causal disease pleiotropy ≥3", "I_landscape", "n_causal_diseases", "ge", 3),
)
RELATIVE_SUCCESS_CLEAN = (
    _T("A. Mendelian ≥5", "A_genetics", "mendelian_n", "ge", 5),
    _T("A. ClinGen Strong/Def ≥1", "A_genetics", "clingen_n_strong", "ge", 1),
    _T("A. GWAS ≥50", "A_genetics", "gwas_n_sig", "ge", 50),
    _T("A. OT genetic ≥0.3", "A_genetics", "ot_genetic_max", "ge", 0.3),
    _T("A. OT somatic ≥0.3", "A_genetics", "ot_somatic_score_max", "ge", 0.3),
    _T("B. Tractable — small mol", "B_mechanistic", "tractability_sm", "true"),
    _T("B. Tractable — antibody", "B_mechanistic", "tractability_ab", "true"),
    _T("B. Bulk Tau ≥0.75", "B_mechanistic", "tau_specificity", "ge", 0.75),
    _T("B. SC Tau ≥0.75", "B_mechanistic", "sc_tau_specificity", "ge", 0.75),
    _T("B. Reactome pathways ≥5", "B_mechanistic", "n_reactome_pathways", "ge", 5),
    _T("B. PPI hub (≥50 partners)", "B_mechanistic", "n_ppi_partners", "ge", 50),
    _T("B. GO-BP ≥20 terms", "B_mechanistic", "n_go_biological_process", "ge", 20),
    _T("C. Line C lit high (≥2)", "C_cell", "line_c_lit", "ge", 2),
    _T("C. DepMap pan-essential", "C_cell", "depmap_pan_essential", "true"),
    _T("D. Line D lit high (≥2)", "D_animal", "line_d_lit", "ge", 2),
    _T("D. OT animal model ≥0.3", "D_animal", "ot_animal_model_max", "ge", 0.3),
    _T("D. IMPC ≥3 phenotypes", "D_animal", "impc_n_phenotypes", "ge", 3),
    _T("D. HPO ≥10 phenotypes", "D_animal", "n_hpo_phenotypes", "ge", 10),
    _T("E. Line E lit high (≥2)", "E_pd", "line_e_lit", "ge", 2),
    _T("H. gnomAD pLI ≥0.9", "H_safety", "gnomad_pli", "ge", 0.9),
    _T("H. gnomAD LOEUF <0.35", "H_safety", "gnomad_loeuf", "lt", 0.35),
    _T("I. Causal disease pleiotropy ≥3", "I_landscape", "n_causal_diseases", "ge", 3),
    _T("I. DGIdb drug precedent ≥5", "I_landscape", "n_dgidb_drugs", "ge", 5),
)
COMBINATIONS = (
    (_T("Mendelian ≥5", "", "mendelian_n", "ge", 5), _T("Tissue-specific (Tau ≥0.75)", "", "tau_specificity", "ge", 0.75)),
    (_T("ClinGen Strong/Def ≥1", "", "clingen_n_strong", "ge", 1), _T("Tissue-specific (Tau ≥0.75)", "", "tau_specificity", "ge", 0.75)),
    (_T("OT genetic ≥0.3", "", "ot_genetic_max", "ge", 0.3), _T("OT animal model ≥0.3", "", "ot_animal_model_max", "ge", 0.3)),
    (_T("Mendelian ≥5", "", "mendelian_n", "ge", 5), _T("Line E lit high (≥2)", "", "line_e_lit", "ge", 2)),
    (_T("ClinGen Strong/Def ≥1", "", "clingen_n_strong", "ge", 1), _T("DepMap NOT pan-essential", "", "depmap_pan_essential", "false")),
    (_T("OT genetic ≥0.3", "", "ot_genetic_max", "ge", 0.3), _T("Reactome pathways ≥5", "", "n_reactome_pathways", "ge", 5)),
    (_T("Line C lit high (≥2)", "", "line_c_lit", "ge", 2), _T("Line D lit high (≥2)", "", "line_d_lit", "ge", 2)),
)
#: Weights of the additive scorer, by column.
RS_WEIGHTS = (
    (_T("ClinGen Strong/Definitive", "A_genetics", "clingen_n_strong", "ge", 1), 0.55),
    (_T("Mendelian associations", "A_genetics", "mendelian_n", "ge", 5), 0.42),
    (_T("OT genetic score", "A_genetics", "ot_genetic_max", "ge", 0.3), 0.29),
    (_T("OT somatic (cancer)", "A_genetics", "ot_somatic_score_max", "ge", 0.3), 0.49),
    (_T("Small-molecule tractable", "B_mechanistic", "tractability_sm", "true"), 0.12),
    (_T("Antibody tractable", "B_mechanistic", "tractability_ab", "true"), 0.14),
    (_T("Reactome pathway membership", "B_mechanistic", "n_reactome_pathways", "ge", 5), 1.03),
    (_T("GO-BP annotation depth", "B_mechanistic", "n_go_biological_process", "ge", 20), 0.24),
    (_T("Tissue-specific (Tau)", "B_mechanistic", "tau_specificity", "ge", 0.75), 0.16),
    (_T("Cell-pathway literature", "C_cell", "line_c_lit", "ge", 2), 0.50),
    (_T("DepMap pan-essential", "C_cell", "depmap_pan_essential", "true"), -2.12),
    (_T("Animal in vivo literature", "D_animal", "line_d_lit", "ge", 2), 0.39),
    (_T("OT animal model score", "D_animal", "ot_animal_model_max", "ge", 0.3), 0.25),
    (_T("IMPC KO phenotypes", "D_animal", "impc_n_phenotypes", "ge", 3), 0.30),
    (_T("HPO phenotype pleiotropy", "D_animal", "n_hpo_phenotypes", "ge", 10), -0.37),
    (_T("Human PD engagement literature", "E_pd", "line_e_lit", "ge", 2), 0.78),
    (_T("gnomAD LoF-intolerant (pLI)", "H_safety", "gnomad_pli", "ge", 0.9), -0.25),
    (_T("gnomAD constrained (LOEUF)", "H_safety", "gnomad_loeuf", "lt", 0.35), -0.30),
    (_T("Causal disease pleiotropy", "I_landscape", "n_causal_diseases", "ge", 3), 0.22),
    (_T("DGIdb drug precedent", "I_landscape", "n_dgidb_drugs", "ge", 5), 0.20),
    (_T("Family precedent (approvals)", "I_landscape", "family_approved_count", "ge", 2), 0.35),
)
#: Factors of the multiplicative scorer, by column.
RS_FACTORS = (
    (_T("", "", "mendelian_n", "ge", 5), 1.53),
    (_T("", "", "clingen_n_strong", "ge", 1), 1.75),
    (_T("", "", "gwas_n_sig", "ge", 50), 1.13),
    (_T("", "", "ot_genetic_max", "ge", 0.3), 1.36),
    (_T("", "", "ot_somatic_score_max", "ge", 0.3), 1.63),
    (_T("", "", "mendelian_n_dominant", "ge", 1), 1.35),
    (_T("", "", "mendelian_n_recessive", "ge", 1), 1.30),
    (_T("", "", "n_reactome_pathways", "ge", 5), 2.81),
    (_T("", "", "n_ppi_partners", "ge", 50), 1.02),
    (_T("", "", "n_go_biological_process", "ge", 20), 1.27),
    (_T("", "", "tau_specificity", "ge", 0.75), 1.17),
    (_T("", "", "sc_tau_specificity", "ge", 0.75), 0.67),
    (_T("", "", "tractability_sm", "true"), 1.13),
    (_T("", "", "tractability_ab", "true"), 1.15),
    (_T("", "", "line_c_lit", "ge", 2), 1.65),
    (_T("", "", "depmap_pan_essential", "true"), 0.12),
    (_T("", "", "line_d_lit", "ge", 2), 1.47),
    (_T("", "", "ot_animal_model_max", "ge", 0.3), 1.28),
    (_T("", "", "impc_n_phenotypes", "ge", 3), 1.35),
    (_T("", "", "n_hpo_phenotypes", "ge", 10), 0.69),
    (_T("", "", "line_e_lit", "ge", 2), 2.18),
    (_T("", "", "gnomad_pli", "ge", 0.9), 0.78),
    (_T("", "", "gnomad_loeuf", "lt", 0.35), 0.74),
    (_T("", "", "family_approved_count", "ge", 2), 1.44),
    (_T("", "", "n_causal_diseases", "ge", 3), 1.24),
    (_T("", "", "n_dgidb_drugs", "ge", 5), 1.20),
)
