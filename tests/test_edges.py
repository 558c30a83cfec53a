"""Queries of the core over tables without a row, and over nulls, repeated rows and clashing columns."""

import pytest
from conftest import same_as_sql

from handloom.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", ["p1_found", "p1_label_totals", "p3_found", "p3_recordings", "code_frequency", "transition_counts", "transition_merge", "codebook_all", "image_hands", "codebook_histogram", "token_oov_fallback", "token_predict", "pipeline_counts", "handedness_flip", "mirror_swap", "class_samples", "streaming_counts", "row_probability"])
def test_against_sql(spark, edge_folder, name):
    got = same_as_sql(spark, edge_folder, QUERIES[name], SQL[name])
    assert bool(got) == ("hostile" in edge_folder)


@pytest.mark.parametrize("name", ["kmeans_tokens", "pca_2d", "group_projection", "overview_2d"])
def test_without_sql(spark, edge_folder, name):
    assert bool(same_as_sql(spark, edge_folder, QUERIES[name], None)) == ("hostile" in edge_folder)


@pytest.mark.parametrize("name", ["transition_stats", "codebook_totals", "feature_stats", "subsample_size"])
def test_totals_have_one_row(spark, edge_folder, name):
    assert len(same_as_sql(spark, edge_folder, QUERIES[name], SQL[name])) == 1
