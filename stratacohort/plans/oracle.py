"""DuckDB SQL for the queries, in the form that defines each operator rather than the one that Spark runs."""
from __future__ import annotations

import re

#: Common tables by name, each over earlier ones.
TABLES = {
    "dx": "SELECT l_orderkey, list_sort(list(DISTINCT '<DX-MAJOR_B' || regexp_replace(p_brand, '[^0-9]', '', 'g') || p_type[1] || '>')) AS dx FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "visits": """SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, o_orderpriority[1] AS vt,
        lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS p FROM orders""",
    "visit_tokens": """SELECT o_custkey, o_orderkey, d, list_concat(list_transform(range(year(d) - coalesce(year(p), 1995)), lambda x: '<NY>'),
        ['<ATT-' || CASE WHEN year(p) = year(d) THEN datediff('day', p, d) ELSE dayofyear(d) - 1 END || '>', '<VT-' || vt || '>'], coalesce(dx, [])) AS t
        FROM visits LEFT JOIN dx ON o_orderkey = l_orderkey""",
    "patient_visits": "SELECT o_custkey, flatten(list(t ORDER BY d, o_orderkey)) AS t, coalesce(sum(len(t)) FILTER (WHERE d < DATE '2000-01-01'), 0) AS n_before FROM visit_tokens GROUP BY o_custkey",
    "traj": """SELECT c_custkey::BIGINT AS row_idx, list_concat(['<BOS>', CASE WHEN c_custkey % 2 = 0 THEN '<SEX-1>' ELSE '<SEX-2>' END, '<NAT-' || c_nationkey || '>', '<AGE_' || (20 + (c_custkey * 7) % 60) || '>'], coalesce(t, [])) AS tok,
        (3 + coalesce(n_before, 0))::BIGINT AS thru FROM customer LEFT JOIN patient_visits ON c_custkey = o_custkey""",
    "tk": "SELECT row_idx, thru, len(tok)::BIGINT AS n_tok, tok[4][6:-2]::BIGINT AS start_age, unnest(tok) AS token, (generate_subscripts(tok, 1) - 1)::BIGINT AS pos FROM traj",
    "ev": "SELECT * FROM tk WHERE pos >= 3 AND pos < least(n_tok, 4096) AND (starts_with(token, '<NY') OR starts_with(token, '<ATT-') OR starts_with(token, '<AGE') OR starts_with(token, '<DX-MAJOR'))",
    "ny": "SELECT row_idx, pos FROM ev WHERE starts_with(token, '<NY')",
    "att": "SELECT row_idx, pos, token[6:-2]::BIGINT AS d FROM tk WHERE starts_with(token, '<ATT-')",
    "att_list": "SELECT row_idx, list(pos ORDER BY pos) AS places FROM att GROUP BY row_idx",
    "years": "SELECT t.row_idx, t.pos, t.token, t.n_tok, t.start_age, t.thru, count(n.pos)::BIGINT AS yrs, coalesce(max(n.pos), -1) AS last_ny FROM ev t LEFT JOIN ny n ON n.row_idx = t.row_idx AND n.pos <= t.pos GROUP BY ALL",
    "ages": "SELECT y.*, coalesce((SELECT sum(a.d) FROM att a WHERE a.row_idx = y.row_idx AND a.pos >= 3 AND a.pos <= y.pos AND a.pos > y.last_ny), 0)::BIGINT AS day FROM years y",
    "located": """SELECT a.*, v, coalesce(places[v + 1], n_tok - 1)::BIGINT AS loc FROM (SELECT a.*, (SELECT count(*) FROM att x WHERE x.row_idx = a.row_idx AND x.pos >= 3 AND x.pos <= a.pos)::BIGINT AS v FROM ages a WHERE starts_with(token, '<DX-MAJOR')) a
        LEFT JOIN att_list USING (row_idx)""",
    "points_all": "SELECT row_idx, thru, token, pos, ((start_age + yrs) * 1461 + 4 * day)::BIGINT AS q, loc FROM located",
    "points_first": "SELECT row_idx, any_value(thru) AS thru, token, min(pos) AS pos, arg_min(q, pos) AS q, arg_min(loc, pos) AS loc FROM points_all GROUP BY row_idx, token",
    "pts": "SELECT * FROM (SELECT row_idx, token, pos, q, loc, (row_number() OVER (PARTITION BY row_idx ORDER BY pos) - 1)::BIGINT AS k, count(*) OVER (PARTITION BY row_idx) AS n FROM points_first WHERE thru + 1 >= 10) WHERE n >= 2",
    "sexes": "SELECT row_idx, CASE WHEN tok[2] = '<SEX-1>' THEN 'male' ELSE 'female' END AS sex FROM traj",
    "tg": "SELECT row_idx, k, token, q, loc, false AS is_sentinel FROM pts WHERE n <= 600 UNION ALL SELECT DISTINCT row_idx, n AS k, NULL, 1461000, 0, true FROM pts WHERE n < 600",
    "counted": "SELECT t.*, (SELECT count(*) FROM tg h WHERE h.row_idx = t.row_idx AND h.k < 599 AND h.q < t.q - 1461)::BIGINT - 1 AS pred_idx FROM tg t WHERE t.k >= 1",
    "lead": "SELECT c.row_idx, c.k, c.token, c.pred_idx, p.q AS pred_q, p.loc AS seq_point FROM counted c LEFT JOIN tg p ON p.row_idx = c.row_idx AND p.k = c.pred_idx",
    "brackets": "SELECT unnest(range(20, 100, 10))::BIGINT AS age",
    "in_bracket": "SELECT * FROM lead JOIN brackets ON pred_idx >= 0 AND pred_q / 1461.0 >= age AND pred_q / 1461.0 < age + 10",
    "first_target": "SELECT row_idx, token, min(k) AS k FROM lead WHERE token IS NOT NULL GROUP BY row_idx, token",
    "cases": "SELECT i.token AS disease, sex, age, row_idx, seq_point FROM in_bracket i JOIN first_target f USING (row_idx, k) JOIN sexes USING (row_idx) WHERE i.token = f.token",
    "first_pred": "SELECT sex, age, row_idx, arg_min(seq_point, k) AS seq_point FROM in_bracket JOIN sexes USING (row_idx) GROUP BY sex, age, row_idx",
    "diseases": "SELECT DISTINCT token AS disease FROM pts",
    "controls": "SELECT disease, sex, age, row_idx, seq_point FROM first_pred f, diseases d WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.row_idx = f.row_idx AND p.token = d.disease AND p.k >= 1)",
    "cohort_all": "SELECT *, 1::BIGINT AS label FROM cases UNION ALL SELECT *, 0::BIGINT AS label FROM controls",
    "cells": "SELECT disease, sex, age, sum(label)::BIGINT AS n_diseased, sum(1 - label)::BIGINT AS n_healthy FROM cohort_all GROUP BY disease, sex, age HAVING sum(label) > 0 AND sum(1 - label) > 0",
    "cohort": "SELECT c.* FROM cohort_all c JOIN cells USING (disease, sex, age)",
    "vocab": "SELECT token, row_number() OVER (ORDER BY token)::BIGINT AS token_id FROM (SELECT DISTINCT token FROM tk WHERE NOT starts_with(token, '<VT-'))",
    "pairs": "SELECT DISTINCT row_idx, seq_point FROM cohort",
    "scored": "SELECT *, ((row_idx * 7919 + seq_point * 31 + length(disease) * 17) % 50)::DOUBLE / 10 + row_idx % 3 AS logit FROM cohort",
    "versus": """SELECT disease, sex, age, a.row_idx AS case_row, b.row_idx AS control_row, CASE WHEN a.logit > b.logit THEN 1.0::DOUBLE WHEN a.logit = b.logit THEN 0.5 ELSE 0 END AS won
        FROM (SELECT * FROM scored WHERE label = 1) a JOIN (SELECT * FROM scored WHERE label = 0) b USING (disease, sex, age)""",
    "areas": "SELECT disease, sex, age, avg(won) AS auc, count(DISTINCT case_row)::BIGINT AS n_diseased, count(DISTINCT control_row)::BIGINT AS n_healthy FROM versus GROUP BY disease, sex, age",
    "case_places": "SELECT disease, sex, age, var_samp(v) / count(*) AS s FROM (SELECT disease, sex, age, case_row, avg(won) AS v FROM versus GROUP BY ALL) GROUP BY disease, sex, age",
    "control_places": "SELECT disease, sex, age, var_samp(v) / count(*) AS s FROM (SELECT disease, sex, age, control_row, avg(won) AS v FROM versus GROUP BY ALL) GROUP BY disease, sex, age",
    "variances": "SELECT disease, sex, age, a.s + b.s AS var FROM case_places a JOIN control_places b USING (disease, sex, age)",
    "two_scored": """SELECT *, 'arithmetic' AS predictor, ((row_idx * 7919 + seq_point * 31 + length(disease) * 17) % 50)::DOUBLE / 10 + row_idx % 3 AS logit FROM cohort
        UNION ALL SELECT *, 'other', ((row_idx * 104729 + seq_point * 13 + length(disease) * 7) % 40)::DOUBLE / 8 + row_idx % 2 FROM cohort""",
    "two_versus": """SELECT predictor, disease, sex, age, a.row_idx AS case_row, b.row_idx AS control_row, CASE WHEN a.logit > b.logit THEN 1.0::DOUBLE WHEN a.logit = b.logit THEN 0.5 ELSE 0 END AS won
        FROM (SELECT * FROM two_scored WHERE label = 1) a JOIN (SELECT * FROM two_scored WHERE label = 0) b USING (predictor, disease, sex, age)""",
    "two_case_places": "SELECT predictor, disease, sex, age, case_row AS subject, avg(won) AS v FROM two_versus GROUP BY ALL",
    "two_control_places": "SELECT predictor, disease, sex, age, control_row AS subject, avg(won) AS v FROM two_versus GROUP BY ALL",
    "case_covariances": "SELECT disease, sex, age, a.predictor AS predictor_a, b.predictor AS predictor_b, avg(a.v) AS auc_a, avg(b.v) AS auc_b, covar_samp(a.v, b.v) / count(*) AS s, count(*)::BIGINT AS n_diseased FROM two_case_places a JOIN two_case_places b USING (disease, sex, age, subject) WHERE a.predictor <= b.predictor GROUP BY ALL",
    "control_covariances": "SELECT disease, sex, age, a.predictor AS predictor_a, b.predictor AS predictor_b, covar_samp(a.v, b.v) / count(*) AS s, count(*)::BIGINT AS n_healthy FROM two_control_places a JOIN two_control_places b USING (disease, sex, age, subject) WHERE a.predictor <= b.predictor GROUP BY ALL",
    "covariances": "SELECT disease, sex, age, predictor_a, predictor_b, auc_a, auc_b, a.s + b.s AS cov, n_diseased, n_healthy FROM case_covariances a JOIN control_covariances b USING (disease, sex, age, predictor_a, predictor_b)",
    "pooled": "SELECT disease, avg(auc) AS auc, count(*)::BIGINT AS n_samples, sum(n_diseased)::BIGINT AS n_diseased, sum(n_healthy)::BIGINT AS n_healthy FROM areas GROUP BY disease",
}

_CLASS = "CASE WHEN starts_with(token, '<NY') THEN 'new_year' WHEN starts_with(token, '<ATT-') THEN 'gap' WHEN starts_with(token, '<AGE') THEN 'age' WHEN starts_with(token, '<DX-MAJOR') THEN 'disease' ELSE 'other' END"
_POOLED = "SELECT disease, round(round(auc, 12), 6) AS auc, n_samples, n_diseased, n_healthy FROM pooled"

SELECTS = {
    "scan_trajectories": "SELECT row_number() OVER (ORDER BY row_idx)::BIGINT - 1 AS row_idx, row_idx AS person_id, row_idx::VARCHAR AS patient_id, CASE WHEN row_idx >= 100 THEN 'b' END AS site, len(tok)::BIGINT AS n_tok, len(tok)::BIGINT - 1 AS total_token_count, thru AS token_count_thru_2022 FROM traj",
    "scan_unlike_shards": "SELECT row_idx AS person_id, CASE row_idx % 3 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN row_idx / 4.0::DOUBLE END AS weight, len(tok)::BIGINT - 1 AS total_token_count, thru AS token_count_thru_2022, 1::BIGINT AS n, true AS numbered FROM traj",
    "token_class_counts": f"SELECT {_CLASS} AS token_class, count(*)::BIGINT AS n FROM tk GROUP BY 1",
    "att_units": "SELECT att_type, row_idx AS person_id, max((start_age + yrs) * 1461 + 4 * day * days)::BIGINT AS max_q FROM located, (VALUES ('day', 1), ('week', 7), ('month', 30)) u(att_type, days) GROUP BY att_type, row_idx",
    "running_age": "SELECT row_idx, pos, yrs, day FROM ages",
    "visit_locations": "SELECT row_idx, pos, v, loc FROM located",
    "disease_points_relative": "SELECT row_idx, token, pos, q, loc FROM points_first",
    "disease_points_all": "SELECT row_idx, token, pos, q, loc FROM points_all",
    "disease_points_absolute": """SELECT row_idx, token, min(pos) AS pos, arg_min(q, pos) AS q, arg_min(loc, pos) AS loc FROM
        (SELECT l.row_idx, token, pos, loc, (coalesce((SELECT arg_max(e.token[6:-2]::BIGINT, e.pos) FROM ev e WHERE e.row_idx = l.row_idx AND starts_with(e.token, '<AGE') AND e.pos <= l.pos), start_age) * 1461
          + 4 * coalesce((SELECT arg_max(a.d, a.pos) FROM att a WHERE a.row_idx = l.row_idx AND a.pos >= 3 AND a.pos <= l.pos), 0))::BIGINT AS q FROM located l) GROUP BY row_idx, token""",
    "min_history_filter": "SELECT row_idx FROM traj WHERE thru >= 9",
    "eval_seq_truncate": "SELECT mode, row_idx, n::BIGINT AS n_eval_tok, array_to_string(list_slice(tok, 1, n), ' ') AS eval_seq FROM (SELECT 'history' AS mode, row_idx, tok, thru + 1 AS n FROM traj UNION ALL SELECT 'whole', row_idx, tok, len(tok) FROM traj)",
    "min_two_points": "SELECT row_idx, count(*)::BIGINT AS n_points FROM points_first WHERE thru >= 9 GROUP BY row_idx HAVING count(*) >= 2",
    "stage1_points": "SELECT row_idx, k, pos, token, q, loc FROM pts",
    "stage1_file": "SELECT row_idx, k, pos, token, q, loc FROM pts",
    "id_list_formats": "SELECT kind, c_custkey::VARCHAR AS id FROM customer, (VALUES ('parquet'), ('csv'), ('txt')) f(kind) WHERE c_nationkey < 5",
    "id_list_semi_join": "SELECT row_idx FROM traj WHERE row_idx IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
    "head_fraction": "SELECT row_idx FROM (SELECT row_idx, row_number() OVER (ORDER BY row_idx) AS r, count(*) OVER () AS n FROM traj) WHERE r <= floor(n * 0.25)",
    "sample_exact_n": "SELECT row_idx FROM traj ORDER BY md5(row_idx::VARCHAR || ':42'), row_idx LIMIT 100",
    "sex_split": "SELECT sex, count(*)::BIGINT AS n FROM sexes GROUP BY sex",
    "sentinel_targets": "SELECT row_idx, k, q::BIGINT AS q, is_sentinel FROM tg",
    "lead_time_asof": "SELECT row_idx, k, token, pred_idx, pred_q::BIGINT AS pred_q, seq_point::BIGINT AS seq_point FROM lead WHERE pred_idx >= 0",
    "age_bracket": "SELECT age, count(*)::BIGINT AS n_targets FROM in_bracket GROUP BY age",
    "case_cohort": "SELECT disease, sex, age, row_idx, seq_point::BIGINT AS seq_point FROM cases",
    "control_anti_join": "SELECT disease, row_idx FROM (SELECT DISTINCT row_idx FROM pts) p, diseases d WHERE NOT EXISTS (SELECT 1 FROM pts x WHERE x.row_idx = p.row_idx AND x.token = d.disease AND x.k >= 1)",
    "control_cohort": "SELECT disease, sex, age, row_idx, seq_point::BIGINT AS seq_point FROM controls",
    "cell_sizes": "SELECT disease, sex, age, n_diseased, n_healthy FROM cells",
    "cell_lists": """SELECT disease, any_value(token_id) AS disease_token, sex, age, 10::BIGINT AS age_step,
        string_agg(row_idx::VARCHAR, ',' ORDER BY row_idx, seq_point) FILTER (WHERE label = 1) AS case_ids, string_agg(row_idx::VARCHAR, ',' ORDER BY row_idx, seq_point) FILTER (WHERE label = 0) AS control_ids,
        string_agg(seq_point::BIGINT::VARCHAR, ',' ORDER BY row_idx, seq_point) FILTER (WHERE label = 1) AS case_seq_points, string_agg(seq_point::BIGINT::VARCHAR, ',' ORDER BY row_idx, seq_point) FILTER (WHERE label = 0) AS control_seq_points
        FROM cohort JOIN (SELECT DISTINCT token, dense_rank() OVER (ORDER BY token)::BIGINT AS token_id FROM tk WHERE starts_with(token, '<DX-MAJOR_')) v ON disease = v.token GROUP BY disease, sex, age""",
    "vocab_disease_map": "SELECT DISTINCT token, dense_rank() OVER (ORDER BY token)::BIGINT AS token_id FROM tk WHERE starts_with(token, '<DX-MAJOR_')",
    "disease_list_filter": "SELECT disease, count(*)::BIGINT AS n_cells FROM cells WHERE disease IN (SELECT '<DX-MAJOR_' || code || '>' FROM (VALUES ('B1S'), ('B13E'), ('B25P'), ('B2M'), ('B2M'), ('NOSUCH')) c(code)) GROUP BY disease",
    "unique_diseases": "SELECT DISTINCT disease FROM cohort",
    "unique_score_pairs": "SELECT row_idx, seq_point::BIGINT AS seq_point FROM pairs",
    "prompt_build": "SELECT row_idx, seq_point::BIGINT AS seq_point, array_to_string(list_slice(list_concat(list_slice(tok, 1, seq_point), ['<NY>', '<INSTRUCT-DX>']), 1, 4096), ' ') AS prompt FROM pairs JOIN traj USING (row_idx)",
    "prompt_ids": """SELECT row_idx, seq_point, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM (SELECT row_idx, seq_point, i, coalesce(token_id, 0) AS id
        FROM (SELECT row_idx, seq_point::BIGINT AS seq_point, unnest(list_concat(list_slice(tok, 1, seq_point), ['<NY>', '<INSTRUCT-DX>'])) AS token, generate_subscripts(list_concat(list_slice(tok, 1, seq_point), ['<NY>', '<INSTRUCT-DX>']), 1) AS i FROM pairs JOIN traj USING (row_idx))
        LEFT JOIN vocab USING (token) WHERE i <= 4096) GROUP BY row_idx, seq_point""",
    "disease_token_ids": "SELECT disease, token_id FROM diseases JOIN vocab ON token = disease",
    "score_subspace": "SELECT row_idx, seq_point::BIGINT AS seq_point, disease, ((row_idx * 7919 + seq_point * 31 + length(disease) * 17) % 50)::DOUBLE / 10 + row_idx % 3 AS logit FROM pairs, diseases",
    "score_model": """SELECT row_idx, seq_point::BIGINT AS seq_point, disease, ((length(prompt) * (place + 2)) % 17)::DOUBLE / 4 AS logit
        FROM (SELECT row_idx, seq_point, array_to_string(list_slice(list_concat(list_slice(tok, 1, seq_point), ['<NY>', '<INSTRUCT-DX>']), 1, 4096), ' ') AS prompt FROM pairs JOIN traj USING (row_idx)),
        (SELECT disease, row_number() OVER (ORDER BY disease) AS place FROM diseases)""",
    "score_join": "SELECT disease, sex, age, label, row_idx, logit FROM scored",
    "missing_scores": "SELECT row_idx, seq_point::BIGINT AS seq_point FROM pairs WHERE row_idx % 7 = 0",
    "midrank": "SELECT a.disease, a.sex, a.age, a.row_idx, count(*) FILTER (WHERE b.logit < a.logit) + (count(*) FILTER (WHERE b.logit = a.logit) + 1) / 2.0::DOUBLE AS midrank FROM scored a JOIN scored b ON a.disease = b.disease AND a.sex = b.sex AND a.age = b.age GROUP BY a.disease, a.sex, a.age, a.row_idx, a.label",
    "cell_auc": "SELECT disease, sex, age, round(round(auc, 12), 6) AS auc, n_diseased, n_healthy FROM areas",
    "cell_auc_variance": "SELECT disease, sex, age, round(round(var, 12), 6) AS var FROM variances",
    "auc_covariance": "SELECT disease, sex, age, predictor_a, predictor_b, round(round(auc_a, 12), 6) AS auc_a, round(round(auc_b, 12), 6) AS auc_b, round(round(cov, 12), 6) + 0.0::DOUBLE AS cov, n_diseased, n_healthy FROM covariances",
    "auc_difference": """SELECT c.disease, c.sex, c.age, c.predictor_a, c.predictor_b, round(round(c.auc_a - c.auc_b, 12), 6) + 0.0::DOUBLE AS difference, round(round(CASE WHEN c.cov IS NOT NULL THEN greatest(a.cov + b.cov - 2 * c.cov, 0) END, 12), 6) AS var, c.n_diseased, c.n_healthy
        FROM covariances c JOIN covariances a ON a.disease = c.disease AND a.sex = c.sex AND a.age = c.age AND a.predictor_a = c.predictor_a AND a.predictor_b = c.predictor_a
        JOIN covariances b ON b.disease = c.disease AND b.sex = c.sex AND b.age = c.age AND b.predictor_a = c.predictor_b AND b.predictor_b = c.predictor_b WHERE c.predictor_a < c.predictor_b""",
    "disease_auc": _POOLED,
    "disease_auc_variance": "SELECT disease, round(round(avg(auc), 12), 6) AS auc, round(round(CASE WHEN count(var) = count(*) THEN sum(var) / (count(*) * count(*)) END, 12), 6) AS var, count(*)::BIGINT AS n_samples FROM areas JOIN variances USING (disease, sex, age) GROUP BY disease",
    "auc_summary": "SELECT count(*)::BIGINT AS n_diseases, round(avg(round(round(auc, 12), 6)), 6) AS mean_auc, count(*) FILTER (WHERE round(round(auc, 12), 6) < 0.5)::BIGINT AS n_below_half FROM pooled",
    "pipeline_e2e": _POOLED,
    "csv_report": _POOLED,
    "kept_stages": _POOLED,
}


def needed(sql: str) -> list[str]:
    """The common tables that sql uses, directly or not, in order."""
    found = {name for name in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql)}
    for name in reversed(TABLES):
        if name in found:
            found |= {n for n in TABLES if n != name and re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b|,\s*{n}\s+d\b", TABLES[name])}
    return [name for name in TABLES if name in found]


def with_tables(sql: str) -> str:
    tables = ",\n".join(f"{name} AS MATERIALIZED ({TABLES[name]})" for name in needed(sql))
    return f"WITH {tables}\n{sql}" if tables else sql


ORACLES = {name: with_tables(sql) for name, sql in SELECTS.items()}
