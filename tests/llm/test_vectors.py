"""Nearest neighbours and whitening against plain computations."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtrack.llm import neighbours, whitening
from tests.llm import tables

# names the operators use for themselves
CLASHING = "vector string, class_id int, list string, block int, asked boolean, x string, v int, dimension string, n int, rank int, score string"
SCHEMA = f"vec_id bigint, embedding array<float>, {CLASHING}"
EXTRA = ("v", 1, "l", 2, True, "x", 3, "d", 4, 5, "s")
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*row, *EXTRA) for row in rows], SCHEMA)


def embeddings(spark):
    tables.documents(spark)
    return spark.read.parquet(f"{tables.DATA}/embeddings.parquet")


def single(x):
    return [float(np.float32(c)) for c in x]


def crowd(seed=3, n=900, size=24):
    """Clusters, scattered vectors, and one vector that a third of all rows hold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, size))
    x = [centres[i % 6] + 0.1 * rng.standard_normal(size) if i % 2 else rng.standard_normal(size) for i in range(n)]
    return [(i, single(x[i] if i % 3 else centres[0])) for i in range(n)]


# --- nearest neighbours ------------------------------------------------------------------------

def true_neighbours(rows, every, k=5):
    """``{(query, place of its row): [(vec_id, score)]}`` of all usable rows."""
    good = [(i, np.array(x, dtype=np.float64)) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    out = []
    for place, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        near = []
        for other, (i, y) in enumerate(good):
            if other != place:
                near.append((-float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))), i is None, i or 0, i))
        # rounding apart, equal vectors have the same score
        near = sorted((round(s, 12), unnamed, number, i) for s, unnamed, number, i in near)[:k]
        out.append((q, [(n[3], -n[0]) for n in near]))
    return sorted(out, key=str)


def found_neighbours(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("rows, every", [(crowd(), 10), (crowd(5, 4000, 40), 50)])
def test_recall_against_brute_force(spark, rows, every):
    found = found_neighbours(neighbours.nearest(frame(spark, rows), F.col("vec_id") % every == 0))
    want = dict(true_neighbours(rows, every))
    assert set(found) == set(want)
    hit = 0
    vectors = {i: np.array(x) for i, x in rows}
    for q, near in want.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] and (a[2] > b[2] or a[1] < b[1]) for a, b in zip(got, got[1:]))
        for _, i, score in got:
            x, y = vectors[q], vectors[i]
            assert i != q and abs(score - x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))) < 1e-12
        hit += len({i for _, i, _ in got} & {i for i, _ in near})
    assert hit / (5 * len(want)) >= 0.95
    # rows with the same vector as a query of the crowd are found, smallest ids first
    same = [i for i, _ in rows if i % 3 == 0]
    for q in [q for q in want if q % 3 == 0]:
        assert [i for _, i, _ in sorted(found[q])] == [i for i in same if i != q][:5]


def test_recall_on_the_table(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in embeddings(spark).select("vec_id", "embedding").collect()]
    found = found_neighbours(neighbours.nearest(embeddings(spark), F.col("vec_id") % 50 == 0))
    want = dict(true_neighbours(rows, 50))
    hit = sum(len({i for _, i, _ in found[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hit / (5 * len(want)) >= 0.9


AWKWARD = [
    (0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.0]),
    (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, NAN, 0.0]), (6, [INF, 1.0, 0.0]), (7, [1.0, None, 2.0]), (8, []),
    (50, [0.0, 1.0, -1.0]), (51, [0.0, -0.0, 1.0]), (100, None), (9, [1e-40, 1e-40, 0.0]), (10, [3e38, 3e38, 0.0]),
]


def test_odd_vectors(spark):
    got = neighbours.nearest(frame(spark, AWKWARD), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = {}
    for r in got.collect():
        rows.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], round(r["score"], 9)))
    want = {}
    for q, near in true_neighbours([(i, x and [np.float32(c) if c is not None else None for c in x]) for i, x in AWKWARD], 50):
        for rank, (i, s) in enumerate(near, 1):
            want.setdefault((q, rank), []).append((i, round(s, 9)))
    # id 0 is there twice and each row is a neighbour of the other; vectors of one direction tie
    assert {k: sorted(v, key=str) for k, v in rows.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_few_or_no_vectors(spark):
    one = F.col("vec_id") % 50 == 0
    assert neighbours.nearest(frame(spark, []), one).collect() == []
    assert neighbours.nearest(frame(spark, [(0, None), (1, [])]), one).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [1.0, 2.0])]), one).collect() == []
    two = neighbours.nearest(frame(spark, [(0, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0])]), one).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 7)]


def test_abandoned_candidates_are_far():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = ((x[:40, None] - x[None]) ** 2).sum(axis=2)
    bounds = np.sort(far, axis=1)[:, 10]
    row, col, _ = neighbours.survivors(x[:40], bounds, np.ascontiguousarray(x.T))
    kept = set(zip(row.tolist(), col.tolist()))
    wanted = {(i, j) for i, j in np.argwhere(far <= bounds[:, None]).tolist()}
    assert len(kept & wanted) / len(wanted) > 0.97
    assert all(far[i, j] <= bounds[i] + 2 * neighbours.SLACK for i, j in kept)


# --- whitening ---------------------------------------------------------------------------------

def plainly(x, number=4):
    """Deviation, whitened values, explained shares of integer rows, through a library's eigenvectors."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(number, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :m] / np.sqrt(values[:m]), values[:m] / values.sum()


@pytest.mark.parametrize("make", ["table", "crowd"])
def test_whitened_values_equal_a_plain_computation(spark, make):
    df = embeddings(spark) if make == "table" else frame(spark, crowd())
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in df.select("vec_id", "embedding").collect())
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    n, deviation, white, explained = plainly(x)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert len(got) == 4 * len(rows)
    for j in range(4):
        mine = np.array([got[i, j + 1]["whitened"] for i, _ in rows])
        assert np.abs(mine * np.sign(mine @ white[:, j]) - white[:, j]).max() < 1e-8
    assert all(r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 for r in got.values())
    assert all(got[i, 1]["deviation"] == d for (i, _), d in zip(rows, deviation.tolist()))


def test_odd_embeddings(spark):
    got = whitening.whiten(frame(spark, AWKWARD + [(11, [1e30, 0.0, 0.0]), (12, [0.25, 0.5, 0.75])]))
    ids = sorted((r["vec_id"] for r in got.where("component = 1").collect()), key=str)
    # zero vectors take part here; null, not finite and too large ones do not
    assert ids == sorted([0, 0, 1, 2, None, 4, 50, 51, 9, 12], key=str)
    assert len({(r["n"], round(r["identity_error"], 6)) for r in got.collect()}) == 1


def test_few_embeddings(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(0, None), (1, [])])).collect() == []
    assert whitening.whiten(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).collect() == []
    two = whitening.whiten(frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in two) == [(0, 1, 1.0, 1.0), (1, 1, 1.0, 1.0)]


def test_deviations_stay_exact_beyond_64_bits():
    centre = whitening.Centre(10**6, [3 * 10**14, -5])
    x = np.array([[2**40, 7], [3 * 10**8, 0]])
    centred, deviation = centre.deviations(x)
    want = [sum((10**6 * int(v) - s) ** 2 for v, s in zip(row, centre.sums)) for row in x]
    assert deviation == [w if w < 2**63 else None for w in want] and deviation[1] == 25
    assert np.allclose(centred, x - np.array(centre.sums) / 10**6)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.sampled_from(["spread", "close", "equal", "rank"]))
def test_components_are_eigenvectors(size, seed, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = {"spread": 10.0 ** rng.uniform(-3, 3, size), "close": 1 + 1e-4 * rng.random(size),
              "equal": np.repeat(rng.random(), size), "rank": np.where(np.arange(size) < 2, 5.0 + np.arange(size), 0)}[kind]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a)
    scale = max(np.abs(values).max(), 1e-30)
    assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13)
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * scale
    assert np.allclose(found, np.sort(values)[::-1], atol=1e-12 * scale)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 10), st.integers(0, 10**6))
def test_polar_factor_is_the_matrix_sign(size, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    sign = rng.choice([-1.0, 1.0], size)
    a = q @ np.diag(sign * 10.0 ** rng.uniform(-6, 1, size)) @ q.T
    assert np.allclose(whitening.polar((a + a.T) / 2), q @ np.diag(sign) @ q.T, atol=1e-8)
