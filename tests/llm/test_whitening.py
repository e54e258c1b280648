"""Whitening against numpy's eigenvectors of the covariance and Python's integers."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from eventide.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string, component string"


def brute(rows, top, scale=64, offset=1_000_000):
    """(vec_id, component) to (deviation, |whitened|, explained), of rows that all remain."""
    x = [[int(np.floor(scale * float(c))) + offset for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], object)
    a = off.astype(float) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), o, row in zip(rows, off, a):
        for j in range(min(top, len(values))):
            out[i, j + 1] = (sum(int(c) ** 2 for c in o), abs(row @ vectors[:, j]) / np.sqrt(values[j]), values[j] / values.sum())
    return out


@pytest.fixture
def vectors(small):
    own = pq.read_table(f"{small}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    return list(zip(own["vec_id"], own["embedding"]))


def test_the_whole_table(spark, small, vectors):
    rows = whitening.whitened(spark.read.parquet(f"{small}/embeddings.parquet").repartition(40)).collect()  # two levels of the tree
    want = brute(vectors, 32)
    assert len(rows) == len(want) == 32 * len(vectors)
    for r in rows:
        deviation, size, explained = want[r["vec_id"], r["component"]]
        assert r["n"] == len(vectors) and r["deviation"] == deviation
        assert abs(r["whitened"]) == pytest.approx(size, abs=1e-6) and r["explained"] == pytest.approx(explained, rel=1e-8)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8
    w = {i: np.zeros(32) for i, _ in vectors}
    for r in rows:
        w[r["vec_id"]][r["component"] - 1] = r["whitened"]
    w = np.array(list(w.values()))
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() == pytest.approx(rows[0]["identity_error"], abs=1e-9)


def test_odd_rows_go_and_columns_with_clashing_names_play_no_part(spark, vectors):
    odd = [(9000, None), (9001, [None] * 64), (9002, [1.0] * 63 + [float("nan")]), (9003, [float("inf")] * 64), (9004, []), (9005, [1.0, 2.0]), (9006, [1e30] * 64)]
    kept = [*vectors[:80], (None, vectors[3][1]), (7, vectors[7][1])]
    made = spark.createDataFrame([(i, v, "x", "y") for i, v in [*kept, *odd]], SCHEMA)
    rows = whitening.whitened(made, top=3).collect()
    assert len(rows) == 3 * len(kept) and {r["n"] for r in rows} == {len(kept)}
    assert sorted({r["vec_id"] for r in rows if r["vec_id"] is not None}) == [i for i, _ in vectors[:80]]
    same = {(r["component"], r["deviation"], r["whitened"]) for r in rows if r["vec_id"] in (None, 3)}
    assert len(same) == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, []), (2, None)]])
def test_nothing_left(spark, rows):
    found = whitening.whitened(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_directions_without_variance_are_null(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], "", "") for i in range(20)]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 60 and all((r["whitened"] is None) == (r["component"] > 1) for r in found)
    assert {round(r["explained"], 9) for r in found} == {1.0, 0.0} and found[0]["identity_error"] < 1e-9
    alone = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], "", "")] * 3, SCHEMA)).collect()
    assert len(alone) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alone)


def test_sums_and_squares_beyond_64_bits_stay_exact():
    x = np.array([[2**61, 1], [2**61, 2], [-(2**61), 3], [2**61, 4], [2**61, 5]], np.int64)
    assert whitening.exact_sums(x) == [3 * 2**61, 15]
    off = whitening.Centre(5, [3 * 2**61, 15]).deviations(x)
    assert off[2, 0] == -8 * 2**61 and off[0, 1] == -10


def test_a_deviation_that_does_not_fit_is_null(spark):
    rows = [(i, [float(2**30 * i), float(i)], "", "") for i in range(6)]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), top=1).collect()
    x = [64 * 2**30 * i + 10**6 for i in range(6)]
    y = [64 * i + 10**6 for i in range(6)]
    want = {i: (6 * x[i] - sum(x)) ** 2 + (6 * y[i] - sum(y)) ** 2 for i in range(6)}
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: d if d < 2**63 else None for i, d in want.items()}


def test_triangles_keep_what_forming_the_covariance_would_lose():
    """Columns that differ by 1e-9 of their size: their squares are beyond a double's precision."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=1000)
    a = np.stack([base, base + 1e-9 * rng.normal(size=1000)], 1)
    r = np.zeros((0, 2))
    for i in range(0, 1000, 100):
        r = whitening.triangle(r, a[i : i + 100])
    assert np.linalg.svd(r)[1] == pytest.approx(np.linalg.svd(a)[1], rel=1e-5)
