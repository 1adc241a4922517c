"""Schemas of the canonical tables."""

from __future__ import annotations

SAMPLES = "sample_id INT, alpha_rad DOUBLE, u_inf DOUBLE, cl DOUBLE, cd DOUBLE"
NODES = "sample_id INT, node_id BIGINT, x DOUBLE, y DOUBLE, implicit_distance DOUBLE, p DOUBLE, ux DOUBLE, uy DOUBLE, nut DOUBLE"
TRIANGLES = "sample_id INT, tri_id BIGINT, n0 BIGINT, n1 BIGINT, n2 BIGINT"
WALL = ("sample_id INT, pos INT, node_id BIGINT, x DOUBLE, y DOUBLE, p DOUBLE, tau_x DOUBLE, tau_y DOUBLE, t_x DOUBLE, t_y DOUBLE, "
        "x_c DOUBLE, upper BOOLEAN")
DATASET = ("sample_id INT, source_name STRING, alpha_deg DOUBLE, U_inf DOUBLE, Re DOUBLE, log10_Re DOUBLE, t_max DOUBLE, x_tmax DOUBLE, "
           "m_max DOUBLE, x_m DOUBLE, Cl DOUBLE, Cd DOUBLE, n_wall_nodes INT, Cl_int_p DOUBLE, Cl_int_tau DOUBLE, Cd_int_p DOUBLE, Cd_int_tau DOUBLE")
CURVES = "sample_id INT, quantity STRING, surface STRING, station INT, x_c DOUBLE, value DOUBLE"
SURFACES = "sample_id INT, x_grid ARRAY<DOUBLE>, y_upper ARRAY<DOUBLE>, y_lower ARRAY<DOUBLE>"
QA_FLAGS = "sample_id INT, qa_pass BOOLEAN, qa_reason STRING"
MEMBERSHIP = "task STRING, role STRING, sample_id INT"
ENVELOPE = "task STRING, feature STRING, lo DOUBLE, hi DOUBLE"
PREDICTIONS = ("task STRING, family STRING, sample_id INT, alpha_deg DOUBLE, Re DOUBLE, t_max DOUBLE, x_tmax DOUBLE, m_max DOUBLE, x_m DOUBLE, "
               "Cl_true DOUBLE, Cd_true DOUBLE, Cl_pred DOUBLE, Cl_std DOUBLE, Cd_pred DOUBLE, logCd_std DOUBLE")
METRICS = ("task STRING, family STRING, target STRING, n_test INT, R2 DOUBLE, RMSE DOUBLE, MAE DOUBLE, spearman DOUBLE, rel_err_mean DOUBLE, "
           "rel_err_median DOUBLE, coverage_2sigma DOUBLE")
REFERENCE_ENTRY = "label STRING, tool STRING, Cl DOUBLE, Cd DOUBLE, file_cp STRING, cp_zone STRING, expected_file STRING, expected_summary_file STRING"
CASE_METADATA = ("validation_cases ARRAY<STRUCT<case_id: STRING, airfoil: STRING, alpha_deg: DOUBLE, Re: DOUBLE, Mach: DOUBLE, "
                 f"references: MAP<STRING, STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in REFERENCE_ENTRY.split(', '))}>>>>, "
                 "tolerances STRUCT<delta_Cl_pct: DOUBLE, delta_Cd_pct: DOUBLE>")
PARAMS = "alpha_deg DOUBLE, Re DOUBLE, thickness DOUBLE, regime STRING, nu DOUBLE"
SAMPLE_STRUCTS = ("sample_id INT, scalars MAP<STRING, DOUBLE>, "
                  "nodes ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, implicit_distance: DOUBLE, p: DOUBLE, ux: DOUBLE, uy: DOUBLE, nut: DOUBLE>>, "
                  "triangles ARRAY<STRUCT<n0: BIGINT, n1: BIGINT, n2: BIGINT>>")
