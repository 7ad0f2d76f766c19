"""Approximate nearest neighbours by cosine: inverted lists that are scanned a few dimensions at a time.

Vectors are scaled to length one and turned by one random rotation, so every
stretch of dimensions tells about the whole distance.  They are dealt to the lists
of their nearest centroids and packed into column blocks, a row of the block per
dimension.  A query scans its own list first, which gives it a bound; in the other
lists it probes, partial distances over the first dimensions are tested against
that bound, and candidates whose whole distance is almost surely beyond it are
abandoned.  The cosine of those that stay is computed from the original vectors.

Equal vectors are one class, so a vector that a third of all rows hold is scanned
once: of its rows only the ``k + 1`` smallest ids can be among ``k`` neighbours.
Lists are cut into blocks of ``BLOCK`` classes and queries into blocks of
``QUERIES``; a task never holds more than one of each.

How many lists a query probes is measured: ``CALIBRATED`` vectors are compared with
all others, and the fewest lists are taken that hold ``PROBED_RECALL`` of their true
neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_groups, in_tasks
from gridtrack.llm.skew import join_groups
from gridtrack.session import stage, stage_scope, unstage

#: centroids are fitted on about this many vectors at most
SAMPLE_ROWS = 65_536
MAX_LISTS = 2048
#: vectors whose true neighbours tell how many lists to probe
CALIBRATED = 256
PROBED_RECALL = 0.99
BLOCK, QUERIES = 1024, 256
#: dimensions per step, and the strictness of the test on partial distances
STEP, EPSILON = 16, 2.1
#: below this share of candidates left, they are followed one by one
SPARSE = 0.1
#: more than single precision can lose on a squared distance of unit vectors
SLACK = 1e-5
_SEED = 20240301

LISTED = "class_id bigint, list int"
PROBES = "class_id bigint, list int, own boolean"
BLOCKS = "list int, size int, turned binary, vectors binary, classes array<bigint>, ids array<array<bigint>>"
ASKED = "list int, classes array<bigint>, vectors binary, bounds array<double>"
FOUND = "query bigint, score double, class_id bigint, ids array<bigint>"


# --- vectors ---------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(size: int) -> np.ndarray:
    """The same random orthogonal matrix in every task."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


@dataclass
class Lists:
    """Rotation and centroids; a vector belongs to the list of its nearest centroid."""

    turn: np.ndarray
    centroids: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (units(x) @ self.turn).astype(np.float32)

    def far(self, turned: np.ndarray) -> np.ndarray:
        """Squared distance to every centroid, up to a term of the vector alone."""
        return (self.centroids * self.centroids).sum(axis=1) - 2 * turned @ self.centroids.T

    @staticmethod
    def fit(sample: np.ndarray, number: int, rounds: int = 8) -> Lists:
        turn = rotation(sample.shape[1])
        x = (units(sample) @ turn).astype(np.float32)
        rng = np.random.default_rng(_SEED)
        lists = Lists(turn, x[rng.choice(len(x), number, replace=False)])
        for _ in range(rounds):
            near = np.concatenate([lists.far(x[i:i + 8192]).argmin(axis=1) for i in range(0, len(x), 8192)])
            order = np.argsort(near, kind="stable")
            full, first = np.unique(near[order], return_index=True)
            lists.centroids[full] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.r_[first, len(x)])[:, None]
        return lists


# --- kernels ---------------------------------------------------------------------------------

def _assign(lists: Lists):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = lists.far(lists.turned(matrix(batch.column("vector")))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(near.astype(np.int32))], names=["class_id", "list"])

    return assign


def _pack(lists: Lists):
    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vector"))
        row = [[table.column("list")[0].as_py()], [len(x)], [np.ascontiguousarray(lists.turned(x).T).tobytes()], [x.tobytes()],
               [table.column("class_id").to_pylist()], [table.column("ids").to_pylist()]]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        return pa.table([pa.array(c, t) for c, t in zip(row, types)], names=["list", "size", "turned", "vectors", "classes", "ids"])

    return pack


def _pack_asked(table: pa.Table) -> pa.Table:
    x = matrix(table.column("vector"))
    row = [[table.column("list")[0].as_py()], [table.column("class_id").to_pylist()], [x.tobytes()], [table.column("bound").to_pylist()]]
    types = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(row, types)], names=["list", "classes", "vectors", "bounds"])


def _probe(lists: Lists, probes: int):
    """Lists of a query, nearest first, after its own."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = lists.far(lists.turned(matrix(batch.column("vector"))))
                own = batch.column("list").to_numpy()
                far[np.arange(len(far)), own] = -np.inf
                order = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class_id").take(pa.array(np.repeat(np.arange(len(far)), order.shape[1]))),
                     pa.array(order.astype(np.int32).ravel()), pa.array(np.tile(np.arange(order.shape[1]) == 0, len(far)))],
                    names=["class_id", "list", "own"])

    return probe


def _true_lists(lists: Lists, asked: np.ndarray, k: int):
    """For calibration: the nearest classes of each vector of ``asked`` within a batch, and their lists."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = units(asked)
        for batch in batches:
            if batch.num_rows:
                score = probe @ units(matrix(batch.column("vector"))).T
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(probe)), best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.astype(np.int32)), pa.array(score[row, best.ravel()]), batch.column("list").take(pa.array(best.ravel()))],
                    names=["probe", "score", "list"])

    return compare


def survivors(asked: np.ndarray, bounds: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and squared distance of the pairs no test on partial distances has abandoned.

    ``asked`` are turned queries by row, ``columns`` turned candidates by column,
    ``bounds`` the squared distance a candidate of each query must not exceed.
    """
    size = asked.shape[1]
    partial = np.zeros((len(asked), columns.shape[1]), dtype=np.float32)
    at = 0
    while at < size:
        upto = min(size, at + STEP)
        q, c = asked[:, at:upto], columns[at:upto]
        partial += (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=0) - 2 * (q @ c)
        at = upto
        open_ = partial <= _limit(bounds, at, size)[:, None]
        if open_.mean() < SPARSE:
            break
    row, col = np.nonzero(open_)
    far = partial[row, col]
    while at < size and row.size:
        upto = min(size, at + STEP)
        apart = asked[row, at:upto] - columns[at:upto, col].T
        far = far + (apart * apart).sum(axis=1)
        at = upto
        stay = far <= _limit(bounds, at, size)[row]
        row, col, far = row[stay], col[stay], far[stay]
    return row, col, far


def _limit(bounds: np.ndarray, seen: int, size: int) -> np.ndarray:
    """Partial distance over ``seen`` dimensions beyond which a candidate is abandoned."""
    if seen == size:
        return bounds + SLACK
    return bounds * (seen / size) * (1 + EPSILON / math.sqrt(seen)) ** 2 + SLACK


def _scan(lists: Lists, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lists.turn.shape[0]
        for batch in batches:
            for pair in batch.to_pylist():
                x = np.frombuffer(pair["asked"]).reshape(-1, size)
                y = np.frombuffer(pair["vectors"]).reshape(-1, size)
                columns = np.frombuffer(pair["turned"], dtype=np.float32).reshape(size, -1)
                row, col, far = survivors(lists.turned(x), np.array(pair["bounds"]), columns)
                # only the nearest of the block need an exact value
                order = np.lexsort((far, row))
                row, col, far = row[order], col[order], far[order]
                first = np.searchsorted(row, np.arange(len(x)))
                last = np.searchsorted(row, np.arange(len(x)), side="right")
                limit = np.full(len(x), np.inf)
                many = last - first >= k
                limit[many] = far[first[many] + k - 1] + SLACK
                near = far <= limit[row]
                row, col = row[near], col[near]
                score = cosine(x[row], y[col])
                ids, classes = pair["ids"], pair["classes"]
                least = np.array([i[0] if i[0] is not None else np.iinfo(np.int64).max for i in ids])
                order = np.lexsort((least[col], -score, row))
                place = np.arange(order.size) - np.searchsorted(row[order], row[order])
                order = order[place < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(pair["queries"], dtype=np.int64)[row[order]]), pa.array(score[order]),
                     pa.array(np.array(classes, dtype=np.int64)[col[order]]),
                     pa.array([ids[i] for i in col[order]], pa.list_(pa.int64()))],
                    names=["query", "score", "class_id", "ids"])

    return scan


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision; only vectors whose squares leave its range are scaled first."""
    if x.size and max(np.abs(x).max(), np.abs(y).max()) > 1e150 or x.size and min(np.abs(x).max(axis=1).min(), np.abs(y).max(axis=1).min()) < 1e-150:
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


# --- the operator ----------------------------------------------------------------------------

def nearest(vectors: DataFrame, asked: Column, k: int = 5, probed_recall: float = PROBED_RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row of ``vectors(vec_id, embedding)`` that ``asked`` holds for.

    Every other row is a candidate, rows with the same id or the same vector
    included.  Scores are cosines of the original vectors; equal scores are ranked by
    id, null ids last.  Vectors that are null, empty or zero, or hold a component that is null
    or not finite, take no part, and neither do those of another length than the
    most frequent one (of several the longest).  A query with fewer than ``k``
    candidates has that many rows; without a candidate it has none.  Other columns
    are ignored.
    """
    with stage_scope() as made:
        v = F.col("embedding").cast("array<double>")
        rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
        rows = rows.where(usable(F.col("vector")))
        lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
        length = lengths["length"] if lengths else 0
        rows = rows.where(F.size("vector") == length)
        queries = stage(rows.where("asked").select("vec_id", "vector"), "nearest-queries")
        classes = _classes(rows, queries, k)
        n = classes.count()
        if n == 0:
            return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
        lists, listed, probes = _index(classes, n, k + 1, probed_recall)
        best = _search(listed, lists, probes, k + 1)
        tops = stage(
            best.groupBy("query").agg(F.collect_list(F.struct("score", "class_id", "ids")).alias("found"))
            .join(classes.where("n_queries > 0").select(F.col("class_id").alias("query"), "vector", "n_queries"), "query"), "nearest-found")
        total = queries.count()
    unstage(*made, keep=(queries, tops))
    return _ranked(join_groups(queries, tops, ["vector"], "n_queries", total), k)


def _classes(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector, with the ids of its first rows; ids beyond them can be in no answer."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last()))
    first = rows.select("vector", "vec_id").withColumn("place", place).where(F.col("place") <= k + 1)
    ids = first.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id"))).alias("ids"))
    counted = queries.groupBy("vector").agg(F.count(F.lit(1)).alias("n_queries"))
    return stage(
        ids.join(counted, "vector", "left").select(
            F.monotonically_increasing_id().alias("class_id"), "vector", F.col("ids.vec_id").alias("ids"),
            F.coalesce("n_queries", F.lit(0)).alias("n_queries")), "nearest-classes")


def _index(classes: DataFrame, n: int, k: int, probed_recall: float) -> tuple[Lists, DataFrame, int]:
    """Lists fitted on a sample, every class with its list, and the number of lists to probe."""
    step = math.ceil(n / SAMPLE_ROWS)
    picked = classes.where(F.pmod(F.xxhash64("class_id"), F.lit(step)) == 0).select("vector").toArrow()
    sample = matrix(picked.column("vector"))
    if len(sample) == 0:
        sample = matrix(classes.select("vector").limit(1).toArrow().column("vector"))
    lists = Lists.fit(sample, max(1, min(MAX_LISTS, math.isqrt(n), len(sample))))
    place = in_tasks(classes.select("class_id", "vector"), _assign(lists), LISTED)
    listed = stage(classes.join(place, "class_id"), "nearest-listed")

    asked = sample[np.random.default_rng(_SEED).permutation(len(sample))[:CALIBRATED]]
    near = in_tasks(listed.select("vector", "list"), _true_lists(lists, asked, k), "probe int, score double, list int")
    order = Window.partitionBy("probe").orderBy(F.desc("score"))
    true = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("probe", "list").toArrow()
    ranks = np.argsort(np.argsort(lists.far(lists.turned(asked)), axis=1, kind="stable"), axis=1)
    depth = np.sort(ranks[true.column("probe").to_numpy(), true.column("list").to_numpy()])
    return lists, listed, 1 + int(depth[min(depth.size - 1, math.ceil(probed_recall * depth.size))])


def _search(listed: DataFrame, lists: Lists, probes: int, k: int) -> DataFrame:
    """``(query, score, class_id, ids)`` of the ``k`` nearest classes found for every class with a query."""
    cut = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    cut = stage(cut, "nearest-sizes")  # a row per list, of which there are MAX_LISTS at most
    blocks = listed.join(F.broadcast(cut), "list").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    packed = stage(in_groups(blocks.select("list", "block", "class_id", "vector", "ids"), ["list", "block"], _pack(lists), BLOCKS), "nearest-blocks")

    asked = listed.where("n_queries > 0").select("class_id", "vector", "list")
    probed = stage(in_tasks(asked, _probe(lists, probes), PROBES), "nearest-probes")
    asked = asked.drop("list")
    far = F.lit(float("inf"))
    found = stage(_best(_pairs(probed.where("own").join(asked, "class_id").withColumn("bound", far), packed, lists, k), k), "nearest-own")
    bounds = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, 2 - 2 * F.min("score")).otherwise(far).alias("bound"))
    rest = probed.where(~F.col("own")).join(asked, "class_id").join(bounds.withColumnRenamed("query", "class_id"), "class_id")
    return _best(found.unionByName(_pairs(rest, packed, lists, k)), k)


def _pairs(probed: DataFrame, packed: DataFrame, lists: Lists, k: int) -> DataFrame:
    """All query blocks of a list against all its column blocks."""
    cut = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).alias("blocks"))
    dealt = probed.join(F.broadcast(cut), "list").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    asked = in_groups(dealt.select("list", "block", "class_id", "vector", "bound"), ["list", "block"], _pack_asked, ASKED)
    both = asked.select("list", F.col("classes").alias("queries"), F.col("vectors").alias("asked"), "bounds").join(packed, "list")
    return in_tasks(both, _scan(lists, k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0].asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Rows of the classes found, without the query's own row."""
    def entries(one: Column) -> Column:
        return F.transform(one["ids"], lambda i: F.struct(
            (-one["score"]).alias("order"), i.isNull().alias("unnamed"), i.alias("vec_id"), (one["class_id"] == F.col("query")).alias("same")))

    every = found.select("query", F.col("vec_id").alias("query_id"), F.sort_array(F.flatten(F.transform("found", entries))).alias("every"))
    own = F.array_position(F.transform("every", lambda e: e["same"] & e["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.slice(F.filter("every", lambda e, i: i != F.col("own") - 1), 1, k)
    return every.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "e")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.order")).alias("score"))
