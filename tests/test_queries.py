"""Every query with SQL gives that SQL's rows; the others give rows."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest
from compare import differences

import parley.plans  # noqa: F401
from parley.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_the_sqls(spark, name):
    assert differences(spark, SF, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "of", "conv_id"), [("simulator_grouped_map", "/root/testdata/check_l", 14127), ("trace_labels", "/root/testdata/sf0.1", 34), ("trace_labels", "/root/testdata/sf0.1", 127)])
def test_equal_times_are_ordered_by_the_conversation_alone(spark, tmp_path, name, of, conv_id):
    """Conversations whose rows in the SQL's result change with the other rows of the table: see README."""
    if not Path(f"{of}/conversations.parquet").exists():
        pytest.skip(f"no {of}")
    for folder, near in (("alone", 0), ("among", 40)):
        (tmp_path / folder).mkdir()
        duckdb.sql(f"COPY (SELECT * FROM read_parquet('{of}/conversations.parquet') WHERE abs(conv_id - {conv_id}) <= {near}) TO '{tmp_path}/{folder}/conversations.parquet' (FORMAT parquet)")
    alone, among = (QUERIES[name](spark, f"{tmp_path}/{folder}") for folder in ("alone", "among"))
    assert among.select("conv_id").distinct().count() > 1
    assert sorted(among.where(f"conv_id = {conv_id}").collect()) == sorted(alone.collect())
    assert differences(spark, f"{tmp_path}/alone", QUERIES[name], ORACLES[name]) == ""
