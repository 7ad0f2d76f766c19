"""Runs compared by digests against a plain comparison of all cells."""

import random

import pytest

from gridtrack.operators import compare

SCHEMA = "frame int, ce_no int, r int, c int, tb smallint"


def cells(seed, frames=130):
    rnd = random.Random(seed)
    return {(f, ce, rnd.randint(0, 90), rnd.randint(0, 90)): rnd.randint(180, 240) for f in range(1, frames, 3) for ce in (1, 2) for _ in range(12)}


def plainly(left, right):
    out = {key[:2]: (0, 0) for key in [*left, *right]}
    for key in {*left, *right}:
        off = abs(left.get(key, 0) - right.get(key, 0))
        if off:
            n, most = out[key[:2]]
            out[key[:2]] = (n + 1, max(most, off))
    return out


def table(spark, held):
    return spark.createDataFrame([(*k, v) for k, v in held.items()], SCHEMA).repartition(3)


@pytest.mark.parametrize("tile", [4, 64])
def test_comparison_equals_that_of_all_cells(spark, tile):
    left, rnd = cells(1), random.Random(2)
    right = dict(left)
    for key in rnd.sample(sorted(left), 25):
        right[key] += rnd.randint(1, 9)
    for key in rnd.sample(sorted(left), 10):
        del right[key]
    right |= {(500, 1, 3, 4): 200}
    # two cells that trade their values
    a, b = rnd.sample([k for k in sorted(right) if k[:2] == (1, 1)], 2)
    right[a], right[b] = right[b] + 1, right[a] + 1
    got = {tuple(x)[:2]: tuple(x)[2:] for x in compare.compare_elements(table(spark, left), table(spark, right), tile).collect()}
    assert got == plainly(left, right)


def test_equal_runs_join_digests_only(spark, monkeypatch):
    left = table(spark, cells(3))
    monkeypatch.setattr(compare, "value_differences", lambda *_: pytest.fail("cells were joined"))
    got = compare.compare_elements(left, left.repartition(7))
    assert {tuple(x)[2:] for x in got.collect()} == {(0, 0)} and got.count() == 86


def test_only_tiles_that_differ_are_opened(spark, monkeypatch):
    left = cells(4)
    right = dict(left)
    key = sorted(left)[50]
    right[key] += 1
    seen, keep = [], compare.value_differences
    monkeypatch.setattr(compare, "value_differences", lambda a, b, *rest: seen.append(a.count()) or keep(a, b, *rest))
    found = compare.compare_elements(table(spark, left), table(spark, right), 16).where("n_different > 0").collect()
    assert [tuple(x) for x in found] == [(*key[:2], 1, 1)] and 0 < seen[0] < 12


def test_empty_runs(spark):
    nothing, some = table(spark, cells(5)).limit(0), table(spark, cells(5, 5))
    assert compare.compare_elements(nothing, nothing).count() == 0
    assert {x.max_difference > 0 for x in compare.compare_elements(nothing, some).collect()} == {True}
