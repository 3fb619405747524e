"""Registered queries against their DuckDB oracles on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from kohort.checks.compare import compare, duckdb_views
from tests.conftest import SF001

FAST = ["s01_screening_scan", "p02_numeric_extract", "p15_blood_pressure_split", "f02_dedup_first_per_nik",
        "f03_null_ratios", "f09_iqr_outliers", "k24_clean_table", "a05_pipeline_counters", "a02_descriptive_stats",
        "k01_scaled_features", "k03_lloyd_labels", "k16_cluster_risk_levels", "k25_village_risk_map",
        "j05_villages_without_boundary", "a10_village_cluster_crosstab", "k06_cluster_evaluation",
        "a12_correlation_matrix", "s05_batch_metadata", "a06_batch_summary", "s21_validation_summary",
        "f04_sparse_columns", "w03_nearest_initial_centre", "j02_alternate_name_fallback", "k09_calinski_harabasz",
        "s20_evaluation_report", "k18_recommendations", "f12_group_median_fill", "s02_header_named_read"]


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF001)


def test_every_query_has_a_builder_and_oracles_are_registered():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 125


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    assert compare(df, con, E.oracle_sql()[name]) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "fill_color" in df.columns
