"""Stored tables: both modes, what is written, and writers that die or meet."""

import pytest
from pyspark.sql import functions as F

from gridtrack.sinks import stored

OLD = [(1, 0, "a", None), (2, 0, None, 1.0), (70, 0, "c", 2.0), (None, 5, "n", None)]
NEW = [(1, 0, "A", 9.0), (2, 0, "B", None), (130, 1, "Z", 4.0), (None, 5, None, 3.0)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables(spark):
    schema = "frame int, no int, name string, rain double"
    return spark.createDataFrame(OLD, schema), spark.createDataFrame(NEW, schema)


@pytest.mark.parametrize("mode, want", [
    (stored.SET_ONCE, [(1, 0, "a", 9.0), (2, 0, "B", 1.0), (70, 0, "c", 2.0), (None, 5, "n", 3.0), (130, 1, "Z", 4.0)]),
    (stored.OVERWRITE, [(1, 0, "A", 9.0), (2, 0, "B", 1.0), (70, 0, "c", 2.0), (None, 5, "n", 3.0), (130, 1, "Z", 4.0)]),
])
def test_modes(spark, tmp_path, mode, want):
    path = str(tmp_path / "table")
    old, new = tables(spark)
    first = stored.create(old, path, ["frame", "no"], "frame div 64")
    second = stored.upsert(path, new, mode)
    assert rows(stored.read(spark, path)) == sorted(want, key=str)
    assert rows(stored.read(spark, path, first.number)) == sorted(OLD, key=str)
    # the part of frame 70 holds no key of the update and is not written again
    assert second.parts["1"] == first.parts["1"] and second.parts["0"] != first.parts["0"] and "2" in second.parts
    # bringing the same in again changes nothing
    stored.upsert(path, new, mode)
    assert rows(stored.read(spark, path)) == sorted(want, key=str)


def test_added_columns_and_no_new_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    old, new = tables(spark)
    stored.create(old, path, ["frame", "no"], "frame div 64")
    stored.upsert(path, new.select("no", "frame", F.lit("M").alias("stage")), insert=False)
    got = stored.read(spark, path)
    assert got.columns == ["frame", "no", "name", "rain", "stage"]
    assert {(r["frame"], r["stage"]) for r in got.collect()} == {(1, "M"), (2, "M"), (70, None), (None, "M")}


def test_nothing_to_bring_in_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    old, new = tables(spark)
    first = stored.create(old.limit(0), path, ["frame", "no"], "frame div 64")
    assert rows(stored.read(spark, path)) == [] and first.parts == {}
    assert stored.upsert(path, new.limit(0)) == first and stored.upsert(path, new, insert=False) == first
    stored.upsert(path, new)
    assert rows(stored.read(spark, path)) == sorted(NEW, key=str)


def test_ambiguous_updates_are_refused(spark, tmp_path):
    path = str(tmp_path / "table")
    old, new = tables(spark)
    stored.create(old, path, ["frame", "no"])
    with pytest.raises(ValueError, match="more than once"):
        stored.upsert(path, new.unionByName(new))
    with pytest.raises(ValueError, match="mode"):
        stored.upsert(path, new, "never")
    assert rows(stored.read(spark, path)) == sorted(OLD, key=str)
    with pytest.raises(FileNotFoundError):
        stored.read(spark, str(tmp_path / "nowhere"))


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    old, new = tables(spark)
    stored.create(old, path, ["frame", "no"], "frame div 64")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(stored, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            stored.upsert(path, new)
    assert rows(stored.read(spark, path)) == sorted(OLD, key=str)
    # tasks that fail half-way leave no state either
    broken = new.withColumn("rain", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        stored.upsert(path, broken)
    assert rows(stored.read(spark, path)) == sorted(OLD, key=str)
    kept = {f.name for f in (tmp_path / "table").glob("data-*")}
    stored.clean(spark, path)
    left = {f.name for f in (tmp_path / "table").glob("data-*")}
    assert left < kept and rows(stored.read(spark, path)) == sorted(OLD, key=str)


def test_writers_that_meet_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    old, new = tables(spark)
    stored.create(old, path, ["frame", "no"], "frame div 64")
    reading = stored.read(spark, path)
    merged, met = stored._merged, []

    def slow(*args):
        state = merged(*args)
        if not met:  # another writer stores its state between reading and storing
            met.append(True)
            stored.upsert(path, spark.createDataFrame([(70, 0, 7.5)], "frame int, no int, other double"))
        return state

    monkeypatch.setattr(stored, "_merged", slow)
    stored.upsert(path, new)
    got = {r["frame"]: (r["rain"], r["other"]) for r in stored.read(spark, path).collect()}
    assert got == {1: (9.0, None), 2: (1.0, None), 70: (2.0, 7.5), None: (3.0, None), 130: (4.0, None)}
    # a reader of the first state still reads it
    assert rows(reading) == sorted(OLD, key=str)
    stored.clean(spark, path, keep=1)
    assert len(list((tmp_path / "table/_snapshots").glob("0*.json"))) == 1
    assert len(stored.read(spark, path).collect()) == 5
