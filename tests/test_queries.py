"""Quick queries of every section against their SQL on the smallest tables; oracle_check.py runs all of them."""

import pytest
from oracle_check import compare, duck

from surveyloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_words_by_language", "a1_typed_survey_scan", "a6_snapshot_fingerprint", "b3_role_standardization", "c1_rule_filter",
    "c5_result_anomalies", "d11_redact_all", "d14_preprocess", "e5_cell_edits", "e6_delete_rows", "f2_categorical_frequency",
    "f9_segment_stats", "f13_metrics_by_stratum", "f15_calibration", "g1_pearson", "g3_cramers_v", "h1_cronbach_alpha",
    "h9_factor_scores", "i2_contradiction_flags", "j1_stratified_split", "k16_sensitivity", "l2_branch_heads", "m5_top_sections",
    "n1_append_rows", "o7_parent_chains", "r6_compare_two_runs",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
