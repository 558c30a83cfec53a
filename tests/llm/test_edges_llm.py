"""Queries for training data over tables without a row, and over nulls, repeated rows and clashing columns."""

import shutil

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from conftest import same_as_sql

from handloom.llm.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p5_found", "p6_found", "p7_decoded"])
def test_against_sql(spark, edge_folder, name):
    got = same_as_sql(spark, edge_folder, QUERIES[name], SQL[name])
    assert bool(got) == ("hostile" in edge_folder)


@pytest.mark.parametrize("name", ["p4_clusters", "p7_ids", "p8_found", "p8_mix", "p8_shares", "p9_found"])
def test_without_sql(spark, edge_folder, name):
    got = same_as_sql(spark, edge_folder, QUERIES[name], None)
    assert bool(got) == ("hostile" in edge_folder)
    if name == "p8_found":
        assert len(got) == len(set(got))


def test_negative_labels_leave_their_recording(spark, edge_folder, tmp_path):
    """A recording that has no label but -1 is in N."""
    if "empty" in edge_folder:
        pytest.skip("needs rows")
    shutil.copytree(edge_folder, tmp_path / "in")
    path = tmp_path / "in" / "histogram.parquet"
    whole = pq.read_table(path)
    alone = whole.filter(pc.equal(whole["label"], 1)).slice(0, 1)
    for name, value in (("file", "only_minus_one"), ("label", -1)):
        alone = alone.set_column(alone.schema.get_field_index(name), name, pa.array([value], alone.schema.field(name).type))
    pq.write_table(pa.concat_tables([whole, alone]), path)
    counted = lambda session, folder: QUERIES["p5_pairs"](session, folder).drop("lift", "pmi")
    assert same_as_sql(spark, str(tmp_path / "in"), counted, SQL["p5_pairs"])
