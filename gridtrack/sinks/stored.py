"""Stored tables that runs update by key.

A stored table is a folder of Parquet parts and of snapshots.  A snapshot is a
small JSON file that names the folder of every part; readers take the one with
the highest number, so they see a whole state or the one before it.  An update
reads and writes only the parts that hold one of its keys, into new folders, and
becomes visible when its snapshot is renamed into place, which fails if another
writer was faster.  A writer that dies before leaves folders that no snapshot names.

``part`` is an SQL expression over the key columns, such as a range of frames;
the number of parts is what a snapshot lists, so it should be far below the
number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOTS = "_snapshots"
SET_ONCE, OVERWRITE = "once", "overwrite"
PART = "_part"


class Conflict(RuntimeError):
    """Another writer stored a snapshot in the meantime."""


@dataclass(frozen=True)
class Snapshot:
    """Keys, schema and part folders of a state of a table."""

    number: int
    keys: list[str]
    part: str
    schema: str
    parts: dict[str, str]


def create(rows: DataFrame, path: str, keys: Sequence[str], part: str = "0") -> Snapshot:
    """Store ``rows`` as the next state of the table at ``path``, whatever it held before.

    Keys must be unique; rows with a null key are rows like others.
    """
    spark = rows.sparkSession
    _unique(rows, keys)
    before = _numbers(spark, path)
    parts = _write(rows, path, part)
    return _commit(spark, path, Snapshot(max(before, default=0) + 1, list(keys), part, rows.schema.json(), parts))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The latest state, or the one with this number."""
    return _rows(spark, path, snapshot(spark, path, number))


def upsert(path: str, updates: DataFrame, mode: str = SET_ONCE, insert: bool = True, attempts: int = 3) -> Snapshot:
    """Bring ``updates`` into the table: every column they have besides the keys, row by row of equal keys.

    ``once`` keeps values that are known and fills those that are null;
    ``overwrite`` replaces all values that the update knows, so a null in an update changes
    nothing in either mode.  Columns the table lacks are added.  Keys that it lacks become
    rows, unless ``insert`` is off.  A key may occur once in ``updates``; null
    keys are equal to each other.
    """
    if mode not in (SET_ONCE, OVERWRITE):
        raise ValueError(f"mode must be {SET_ONCE} or {OVERWRITE}, not {mode}")
    spark = updates.sparkSession
    for attempt in range(attempts):
        old = snapshot(spark, path)
        new = _merged(spark, path, old, updates, mode, insert)
        if new is None:
            return old
        try:
            return _commit(spark, path, new)
        except Conflict:
            if attempt + 1 == attempts:
                raise
    raise AssertionError("unreachable")


def _merged(spark: SparkSession, path: str, old: Snapshot, updates: DataFrame, mode: str, insert: bool) -> Snapshot | None:
    """The state after an update, its parts written; None if there is nothing to bring in."""
    _unique(updates, old.keys)
    schema = StructType.fromJson(json.loads(old.schema))
    fresh = [c for c in updates.columns if c not in old.keys]
    types = {f.name: f.dataType for f in updates.schema}
    touched = [_name(r[0]) for r in updates.select(F.expr(old.part)).distinct().collect()]
    if not insert:
        touched = [p for p in touched if p in old.parts]
    if not touched:
        return None
    added = [c for c in fresh if c not in schema.names]
    for name in added:
        schema = schema.add(name, types[name])
    now = _rows(spark, path, Snapshot(old.number, old.keys, old.part, schema.json(), {p: old.parts[p] for p in touched if p in old.parts}))
    new = updates.select(*[F.col(k).alias(f"key {k}") for k in old.keys], *[F.col(c).cast(schema[c].dataType).alias(f"new {c}") for c in fresh], F.lit(True).alias("new row"))
    # a row of the table has a mark too: all its keys can be null
    now = now.withColumn("old row", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"key {k}")) for k in old.keys])
    joined = now.join(new, same, "full_outer" if insert else "left_outer")

    def value(name: str):
        if name in old.keys:
            return F.when(F.col("old row"), F.col(name)).otherwise(F.col(f"key {name}")).alias(name)
        if name not in fresh:
            return F.col(name)
        order = (F.col(name), F.col(f"new {name}"))
        return F.coalesce(*(order if mode == SET_ONCE else order[::-1])).alias(name)

    parts = _write(joined.select(*[value(name) for name in schema.names]), path, old.part)
    return Snapshot(old.number + 1, old.keys, old.part, schema.json(), old.parts | parts)


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` states and the folders that only they, or dead writers, name.

    No update may be running.
    """
    numbers = sorted(_numbers(spark, path))
    kept = [snapshot(spark, path, n) for n in numbers[-keep:]]
    folders = {folder.split("/")[0] for state in kept for folder in state.parts.values()}
    fs, root = _file_system(spark, path)
    for status in fs.listStatus(root):
        if status.getPath().getName() not in folders | {SNAPSHOTS}:
            fs.delete(status.getPath(), True)
    for number in numbers[:-keep]:
        fs.delete(_path(spark, f"{path}/{SNAPSHOTS}/{number:010d}.json"), False)


# --- rows ----------------------------------------------------------------------------------------

def _unique(rows: DataFrame, keys: Sequence[str]) -> None:
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the key {tuple(twice[0][k] for k in keys)} occurs more than once")


def _name(part) -> str:
    return "null" if part is None else str(part)


def _write(rows: DataFrame, path: str, part: str) -> dict[str, str]:
    """Write rows by part into a new folder; large parts are several files."""
    folder = f"data-{uuid.uuid4().hex}"
    named = rows.withColumn(PART, F.coalesce(F.expr(part).cast("string"), F.lit("null"))).hint("rebalance", F.col(PART))
    named.write.partitionBy(PART).parquet(f"{path}/{folder}")
    fs, _ = _file_system(rows.sparkSession, path)
    found = [s.getPath().getName() for s in fs.listStatus(_path(rows.sparkSession, f"{path}/{folder}")) if s.isDirectory()]
    return {name.split("=", 1)[1]: f"{folder}/{name}" for name in found if name.startswith(f"{PART}=")}


def _rows(spark: SparkSession, path: str, state: Snapshot) -> DataFrame:
    schema = StructType.fromJson(json.loads(state.schema))
    if not state.parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in state.parts.values()])


# --- snapshots -----------------------------------------------------------------------------------

def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    number = number or max(_numbers(spark, path), default=None)
    if number is None:
        raise FileNotFoundError(f"{path} holds no stored table")
    fs, _ = _file_system(spark, path)
    stream = fs.open(_path(spark, f"{path}/{SNAPSHOTS}/{number:010d}.json"))
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Snapshot(**json.loads(text))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, _ = _file_system(spark, path)
    folder = _path(spark, f"{path}/{SNAPSHOTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]


def _commit(spark: SparkSession, path: str, state: Snapshot) -> Snapshot:
    """Make a state visible, unless its number is taken."""
    fs, _ = _file_system(spark, path)
    draft = _path(spark, f"{path}/{SNAPSHOTS}/.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(asdict(state)).encode()))
    finally:
        stream.close()
    final = _path(spark, f"{path}/{SNAPSHOTS}/{state.number:010d}.json")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(f"snapshot {state.number} of {path} exists") from error
        raise
    return state


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root
