"""Queries against plain SQL on a table whose columns run on past 180 and past 355 degrees."""

import pytest

import __spark_entry__ as driver
from tests.test_queries import connect, rows

duckdb = pytest.importorskip("duckdb")

# 1,500 columns of 16 rows, 40 events a cell in 5 days; low values on three bands of columns
EVENTS = """
SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + (event_id // 24000 % 5) * INTERVAL 1 DAY + (event_id // 120000 * 3) * INTERVAL 1 HOUR AS ts,
       event_id % 150 AS user_id, 'click' AS event_type,
       CASE WHEN (c < 20 OR c BETWEEN 725 AND 765 OR c BETWEEN 1435 AND 1460) AND h < 1600 THEN h / 80.0
            ELSE 20.0 + h / 100.0 END AS value, '{}' AS props
FROM (SELECT range AS event_id, range // 16 % 1500 AS c, hash(range) % 16000 AS h FROM range(960000))"""


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    duckdb.connect().execute(f"COPY ({EVENTS}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["clip_domain", "element_center", "element_pixel_list", "element_precip", "netcdf_round_trip"])
def test_longitudes_of_the_driver_grid_are_not_folded(spark, wide, name):
    got = driver.queries()[name](spark, wide)
    want = connect(wide).execute(driver.oracle_sql()[name])
    names = [x[0] for x in want.description]
    found = rows(got.columns, got.collect())
    assert found and found == rows(names, want.fetchall())


def test_files_of_elements_do_not_grow_with_the_grid(spark, wide, tmp_path, monkeypatch):
    from gridtrack.plans import queries as plans

    monkeypatch.setattr(plans, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    found = plans.netcdf_round_trip(spark, wide).groupBy("frame", "ce_no").count().collect()
    sizes = [x.stat().st_size for x in (tmp_path / "element-grids").glob("*.nc")]
    assert len(sizes) == len(found) > 100
    # a plain grid takes 192,000 bytes
    assert sum(sizes) < sum(2000 + 12 * x["count"] for x in found)


# 37 columns of 16 rows in 5 days; two groups of four columns have events at noon only, so slices of midnight lack them
SLICED = """
SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + (event_id // 592 % 5) * INTERVAL 1 DAY
                 + CASE WHEN c BETWEEN 8 AND 11 OR c BETWEEN 20 AND 23 THEN INTERVAL 12 HOUR ELSE INTERVAL 1 HOUR END AS ts,
       event_id % 150 AS user_id, 'click' AS event_type,
       CASE WHEN h % 16 = 0 THEN h // 16 % 20 ELSE 20.0 + h // 16 % 6000 / 100.0 END AS value, '{}' AS props
FROM (SELECT range AS event_id, range // 16 % 37 AS c, hash(range) AS h FROM range(24000))"""


@pytest.fixture(scope="module")
def sliced(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sliced")
    duckdb.connect().execute(f"COPY ({SLICED}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["element_precip", "accum_range", "element_precip_asof"])
def test_coarse_axes_are_those_of_the_whole_dataset(spark, sliced, name):
    got = driver.queries()[name](spark, sliced)
    want = connect(sliced).execute(driver.oracle_sql()[name])
    names = [x[0] for x in want.description]
    found = rows(got.columns, got.collect())
    assert found and found == rows(names, want.fetchall())
