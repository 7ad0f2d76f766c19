"""Whitening of embeddings by spectral divide and conquer.

Entries become the integers ``floor(256 * c)``, so counts, sums and deviations are
exact and do not depend on the order of rows.  Tasks add up sums and centred
products of the distinct vectors; what reaches the driver is one matrix of
dimension by dimension, whatever the number of rows.

Its eigenvectors come from polar decompositions: the polar factor of ``A - s I`` is
the matrix sign, so ``(U + I) / 2`` projects on the eigenvectors above ``s``.  It is
found by the dynamically weighted Halley iteration in its QR form (QDWH).  The two
invariant subspaces are split further until each is one component.  The components
are then broadcast, and every task whitens its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrack.llm.kernels import in_groups, in_tasks
from gridtrack.session import stage, stage_scope, unstage

SCALE = 256
#: entries beyond it count as not finite, so sums of a batch stay exact
LARGEST = 2**44
#: a component is one whose eigenvalue is this share of the largest one at least
LEAST = 1e-12
SALTS = 64
_LOW = 1 << 24

SUMS = "dimension int, high bigint, low bigint, n bigint"
PRODUCTS = "dimension int, salt int, products array<double>"
WHITE = "vec_id bigint, component int, deviation bigint, whitened double"


# --- components, on the driver: a matrix of dimension by dimension -----------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without a zero eigenvalue, by QDWH iterations."""
    size = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the smallest singular value; one that is too low costs a round at most
    low = max(1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(size)), np.finfo(float).eps)
    one = np.eye(size)
    for _ in range(40):
        d = np.cbrt(4 * max(0.0, 1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if moved < 1e-15 * size and low > 1 - 1e-15 * size:
            break
    # one Newton-Schulz step takes away what rounding left
    return x @ (3 * one - x.T @ x) / 2


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; None if all eigenvalues are the same."""
    size = len(a)
    centre = np.trace(a) / size
    spread = np.linalg.norm(a - centre * np.eye(size))
    if spread <= 4 * np.finfo(float).eps * size * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    # the median of the diagonal cuts about in half; beside it, shifts that do not hit an eigenvalue
    for shift in [np.median(np.diag(a)), centre, *(centre + spread / size * rng.uniform(-1, 1, 20))]:
        try:
            u = polar(a - shift * np.eye(size))
        except np.linalg.LinAlgError:
            continue
        projector = (u + np.eye(size)) / 2
        above = round(np.trace(projector))
        if not 0 < above < size or np.linalg.norm(projector @ projector - projector) > 1e-9:
            continue
        basis = np.column_stack([projector @ rng.standard_normal((size, above)),
                                 rng.standard_normal((size, size - above))])
        basis[:, above:] -= projector @ basis[:, above:]
        for _ in range(2):
            q, _ = np.linalg.qr(basis)
            basis = np.column_stack([projector @ q[:, :above], q[:, above:] - projector @ q[:, above:]])
        q, _ = np.linalg.qr(basis)
        high, low = q[:, :above], q[:, above:]
        if np.linalg.norm(high.T @ a @ low) <= 1e-10 * np.linalg.norm(a):
            return high, low
    raise ArithmeticError("no shift divides the spectrum")


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    rng = np.random.default_rng(20240302)
    found, open_ = [], [np.eye(len(a))]
    while open_:
        basis = open_.pop()
        halves = split(_within(a, basis), rng) if basis.shape[1] > 1 else None
        if halves is None:
            found.append(basis)
        else:
            open_ += [basis @ half for half in halves]
    vectors, _ = np.linalg.qr(np.hstack(found))
    vectors = _refined(a, vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _within(a: np.ndarray, basis: np.ndarray) -> np.ndarray:
    inner = basis.T @ a @ basis
    return (inner + inner.T) / 2


def _refined(a: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """First-order corrections of nearly exact eigenvectors."""
    for _ in range(2):
        inner = _within(a, vectors)
        values = np.diag(inner)
        apart = values[None, :] - values[:, None]
        clear = np.abs(apart) > 1e-7 * max(np.abs(values).max(), np.finfo(float).tiny)
        turn = np.where(clear, inner / np.where(clear, apart, 1), 0)
        np.fill_diagonal(turn, 0)
        vectors, r = np.linalg.qr(vectors @ (np.eye(len(a)) + turn))
        vectors = vectors * np.sign(np.diag(r))
    return vectors


# --- kernels -----------------------------------------------------------------------------------

def _integers(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch.column(0))
            part = np.vstack([(x // _LOW).sum(axis=0), (x % _LOW).sum(axis=0), np.full(x.shape[1], len(x))])
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], names=["dimension", "high", "low", "n"])


class Centre:
    """Exact sums of the distinct vectors; deviations from their mean."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.most = max(map(abs, sums), default=0)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """``x - S / n`` as doubles, and the exact sums of the squares of ``n * x - S``, null beyond 64 bits."""
        largest = self.n * int(np.abs(x).max(initial=0)) + self.most
        if largest < 2**62:
            scaled = x * self.n - np.array(self.sums, dtype=np.int64)
        else:
            scaled = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        centred = (scaled / self.n).astype(np.float64)
        if largest * largest * x.shape[1] < 2**63:
            return centred, (scaled * scaled).sum(axis=1).tolist()
        squares = [sum(int(v) * int(v) for v in row) for row in scaled]
        return centred, [s if s < 2**63 else None for s in squares]


def _products(centre: Centre, components: np.ndarray | None = None):
    """Sums of the products of centred rows of a task, or of their whitened values."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, batch = None, None
        for batch in batches:
            if batch.num_rows:
                y, _ = centre.deviations(_integers(batch.column(0)))
                y = y if components is None else np.column_stack([y @ components, np.ones(len(y))])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            salt = int(np.random.default_rng().integers(SALTS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), salt, dtype=np.int32)),
                 pa.array(list(total), pa.list_(pa.float64()))], names=["dimension", "salt", "products"])

    return products


def _added(table: pa.Table) -> pa.Table:
    total = np.sum(table.column("products").combine_chunks().flatten().to_numpy().reshape(len(table), -1), axis=0)
    return pa.table({"dimension": table.column("dimension")[:1], "salt": table.column("salt")[:1], "products": pa.array([total], pa.list_(pa.float64()))})


def _whiten(centre: Centre, components: np.ndarray):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = components.shape[1]
        for batch in batches:
            if batch.num_rows:
                y, deviation = centre.deviations(_integers(batch.column("x")))
                row = pa.array(np.repeat(np.arange(len(y)), many))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(y))),
                     pa.array(deviation, pa.int64()).take(row), pa.array((y @ components).ravel())],
                    names=["vec_id", "component", "deviation", "whitened"])

    return whiten


# --- the operator --------------------------------------------------------------------------------

def finite(vector: Column) -> Column:
    """Not null, and no entry is null, not finite or beyond ``LARGEST`` when scaled."""
    every = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < F.lit(float(LARGEST))))
    return vector.isNotNull() & F.coalesce(every, F.lit(False))


def whiten(embeddings: DataFrame, number: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    Rows of ``embeddings(vec_id, embedding)`` whose vector is null or empty, has another
    length than the most frequent one (of several the longest), or holds an entry
    that is null, not finite or beyond ``LARGEST / 256``, are dropped.  Components are fitted on each
    distinct vector of integers once, so repeated rows do not weigh; every
    repeated row has its own result.  Components without variance have no whitened values
    and are left out: one distinct vector gives no rows.  ``deviation`` is null where
    64 bits do not hold it.  Null ids stay null; other columns are ignored.
    """
    with stage_scope() as made:
        v = F.col("embedding").cast("array<double>")
        rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
        rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))
        lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
        length = lengths["length"] if lengths else 0
        rows = stage(rows.where(F.size("x") == length), "whitening-integers")
        fit = stage(rows.select("x").distinct(), "whitening-distinct")

        sums = in_tasks(fit, _sums, SUMS).groupBy("dimension").agg(
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]).orderBy("dimension").collect()
        n = int(sums[0]["n"]) if sums else 0
        centre = Centre(n, [int(r["high"]) * _LOW + int(r["low"]) for r in sums])
        covariance = _covariance(fit, _products(centre)) / n if n else np.zeros((0, 0))
        values, vectors = components(covariance) if n else (np.zeros(0), covariance)
        kept = [i for i in range(min(number, len(values))) if values[i] > LEAST * values[0] and values[0] > 0]
        scaled = vectors[:, kept] / np.sqrt(values[kept])
        error = 0.0
        if kept:
            white = _covariance(fit, _products(centre, scaled)) / n
            inner = white[:-1, :-1] - np.outer(white[-1, :-1], white[-1, :-1])
            error = float(np.abs(inner - np.eye(len(kept))).max())
    unstage(*made, keep=(rows,))
    shares = values[kept] / np.trace(covariance) if kept else []
    explained = F.element_at(F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>"), F.col("component"))
    return in_tasks(rows if kept else rows.limit(0), _whiten(centre, scaled), WHITE).select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"))


def _covariance(fit: DataFrame, kernel) -> np.ndarray:
    """Sum of the matrices of all tasks, added up by row and salt before the driver sees it."""
    parts = in_groups(in_tasks(fit, kernel, PRODUCTS), ["dimension", "salt"], _added, PRODUCTS)
    rows = in_groups(parts, ["dimension"], _added, PRODUCTS).orderBy("dimension").toArrow()
    return np.array(rows.column("products").to_pylist(), dtype=np.float64)
