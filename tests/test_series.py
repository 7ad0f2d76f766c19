"""As-of joins and running sums against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridtrack.operators import asof, scans

START = datetime(2009, 8, 31)


def series(rnd, n, span):
    """Odd times with gaps, ties and nulls."""
    return [None if rnd.random() < 0.05 else START + timedelta(seconds=rnd.randint(0, span) // rnd.choice([1, 60]) * rnd.choice([1, 1, 60]) % span)
            for _ in range(n)]


@pytest.mark.parametrize("tolerance, block", [(600, None), (600, 90), (600, 5000), (0, None), (3600, 1000.5)])
def test_latest_row_within_the_tolerance(spark, tolerance, block):
    rnd = random.Random(4)
    left = [(i, rnd.choice(["a", "b", None]), ts) for i, ts in enumerate(series(rnd, 150, 9000))]
    right = [(rnd.choice(["a", "b", None]), ts, rnd.randint(0, 9), rnd.choice(["x", None])) for ts in series(rnd, 60, 9000)]
    right += [(k, left[i][2], 3, "same") for i, k in ((3, "a"), (4, "b"), (5, None))]
    found = asof.asof_join(
        spark.createDataFrame(left, "no int, k string, ts timestamp_ntz"),
        spark.createDataFrame(right, "k string, ts timestamp_ntz, v int, w string"), ["k"], ["v", "w"], tolerance, block)
    assert found.columns == ["no", "k", "ts", "right_ts", "v", "w"]
    want = {}
    for no, k, ts in left:
        near = [(t, v, w is not None, w) for key, t, v, w in right if k is not None and key == k and None not in (t, ts) and t <= ts
                and ts - t <= timedelta(seconds=tolerance)]
        want[no] = (max(near)[0], max(near)[1], max(near)[3]) if near else (None, None, None)
    assert {r.no: (r.right_ts, r.v, r.w) for r in found.collect()} == want
    assert any(x[0] for x in want.values()) and not all(x[0] for x in want.values())


def test_series_without_keys_and_empty_ones(spark):
    left = spark.createDataFrame([(1, START), (2, START + timedelta(hours=5))], "no int, ts timestamp_ntz")
    right = spark.createDataFrame([(START - timedelta(minutes=7),)], "ts timestamp_ntz")
    assert {r.no: r.right_ts for r in asof.asof_join(left, right, [], [], 3600).collect()} == {1: START - timedelta(minutes=7), 2: None}
    assert {r.right_ts for r in asof.asof_join(left, right.limit(0), [], [], 3600).collect()} == {None}
    assert asof.asof_join(left.limit(0), right, [], [], 3600).count() == 0


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_running_sums_equal_a_loop(spark, block):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([0, 1, 5, 40, 41, 97]), rnd.choice([1.5, -2.0, None, 4.0])) for i in range(120)]
    got = scans.running_sum(spark.createDataFrame(rows, "no int, k string, at int, v double"), ["k"], "at", "v", block)
    assert got.columns == ["no", "k", "at", "v", "running"]
    want = {no: sum(v or 0 for _, key, place, v in rows if key == k and place <= at) for no, k, at, _ in rows}
    assert {r.no: r.running for r in got.collect()} == pytest.approx(want)
    assert scans.running_sum(got.drop("running").limit(0), ["k"], "at", "v", block).count() == 0


def test_no_group_is_longer_than_a_block(spark, monkeypatch):
    """A series of 5,000 places in blocks of 10: four levels, and windows see 10 places at most."""
    staged, keep = [], scans.stage
    monkeypatch.setattr(scans, "stage", lambda df, name: staged.append(df) or keep(df, name))
    rows = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit(1.0).alias("v"))
    got = scans.running_sum(rows, ["k"], "at", "v", 10)
    assert got.where("running <> at + 1").count() == 0
    assert len(staged) == 4
