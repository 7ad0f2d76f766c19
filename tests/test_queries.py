"""Registered queries against plain SQL on the small driver tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as driver
from gridtrack.plans import oracle, queries as plans

DATA = "/root/testdata/sf0.001"
# large enough for pruned paths and systems to exist
GRAPH_DATA = "/root/testdata/sf0.01"
duckdb = pytest.importorskip("duckdb")


def connect(data):
    if not Path(data).exists():
        pytest.skip("driver tables are not here")
    link = duckdb.connect()
    for file in Path(data).glob("*.parquet"):
        link.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return link


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else float(value)
    return str(value)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in table), key=str)


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(plans.registered()) == set(oracle.ORACLE)


CASES = [(name, DATA) for name in (
    "mask_threshold", "label_components_tiled", "element_stats", "element_ids", "clip_domain",
    "regrid_bilinear", "regrid_cubic", "element_precip", "valid_date", "time_step_class", "model_time",
    "missing_files", "value_histogram", "stored_rain", "netcdf_round_trip", "accum_running", "asof_events", "element_precip_asof",
)] + [(name, GRAPH_DATA) for name in ("edges_weighted", "pruned_edges", "path_depth", "root_path_list", "stored_stages", "mcs_members", "mcc_members", "node_stage", "complex_report")]


@pytest.mark.parametrize("name, data", CASES)
def test_query_equals_sql(spark, name, data):
    got = driver.queries()[name](spark, data)
    want = connect(data).execute(driver.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    found = rows(got.columns, got.collect())
    assert found and found == rows(names, want.fetchall())


def test_flagship(spark):
    if not Path(DATA).exists():
        pytest.skip("driver tables are not here")
    assert driver.entry(spark).count() > 0
