import math
import os

import duckdb
import pytest

from cohortline.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
QUICK = [
    "family_metrics", "protocol_checks", "block_a", "block_h", "block_v", "block_t_fit_apply", "prior_transform", "fold_safe_te", "kfold_assign", "holdout_assign", "query_groups", "rank_pairs", "drift_numeric",
    "drift_categorical", "noise_audit", "fold_suspects", "alpha_scan_residual", "rank_reassign", "chain_shift_stats", "blend_inversion", "repeated_cv_auc", "metrics_rollup", "knn_embeddings", "json_leaves_events",
    "signatures", "duplicate_summary", "duplicate_flags", "suspicious_families", "frame_compatibility", "joint_strata", "leave_family_out", "dominance_slices", "dominance_verdict", "error_groups", "signal_alpha_scan",
    "chain_submission_base", "ensemble_robustness", "chain_protocol", "gate_checks", "boosted_histogram", "boosted_first_tree", "pair_lambdas",
    "blend_moves", "label_noise_audit",
]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    at = {x[0]: i for i, x in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got == sorted((tuple(norm(r[at[c]]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_each_query_has_sql_but_the_learners():
    assert all(n in ORACLES for n in QUERIES if not n.startswith("learner_"))
