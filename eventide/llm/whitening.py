"""Whitening of embeddings by a tall, skinny QR: the covariance is never formed.

Rows are centred by exact sums; every partition reduces its rows to a triangle R, block by block, triangles are merged in
a tree whose fan-in is fixed, and the right singular vectors of the last one are the covariance's eigenvectors: V = R'R / n.
What reaches the driver is one width x width triangle and sums by dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Entries of greater size have no 64-bit number x = floor(scale * c) + offset for the scales in use.
LARGEST = 2.0**56
#: Triangles that one task merges.
FAN_IN = 16
EXACT = pa.decimal128(38, 0)


class Centre(NamedTuple):
    """How many vectors there are, and their exact sum in each dimension."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they hold it, else Python's."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max((abs(s) for s in self.sums), default=0)
        return self.n * x - np.array(self.sums, np.int64) if most < 1 << 62 else self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return self.deviations(x).astype(np.float64) / self.n


class Axes(NamedTuple):
    """Eigenvectors as columns, their eigenvalues, and the trace of the covariance. An eigenvalue that is zero but for rounding is 0."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """NaN in a direction without variance."""
        scale = np.where(self.values > 0, np.sqrt(self.values), np.nan)
        return centred @ self.vectors / scale


def integers(vectors: pa.Array, width: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their entries as floor(scale * c) + offset."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    cells = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    held = np.maximum(lengths, 0)
    own = np.flatnonzero(lengths == width)
    entries = cells[(np.cumsum(held) - held)[own, None] + np.arange(width)]
    with np.errstate(invalid="ignore"):
        good = (np.abs(entries) <= LARGEST).all(axis=1)  # NaN isn't
    return own[good], np.floor(entries[good] * scale).astype(np.int64) + offset


def exact_sums(x: np.ndarray) -> list[int]:
    small = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * max(len(x), 1) < 1 << 62
    return [int(s) for s in (x if small else x.astype(object)).sum(axis=0)]


def triangle(*parts: np.ndarray) -> np.ndarray:
    """R of the rows of all parts, one under the other."""
    return np.linalg.qr(np.vstack(parts), mode="r")


def axes(r: np.ndarray, n: int, top: int) -> Axes:
    """The first ``top`` eigenvectors of R'R / n; each has its largest entry positive."""
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(len(vt) - len(s))])
    values = np.where(s > s[0] * len(s) * 16 * np.finfo(float).eps, s**2 / n, 0.0)
    v = vt[:top].T
    return Axes(v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]), values[:top], float((s**2).sum() / n))


def _by_batch(rows: DataFrame, schema: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(iter(batches))

    return rows.mapInArrow(run, schema)


def centre(rows: DataFrame, width: int, scale: int, offset: int) -> Centre:
    """Exact sums of the remaining vectors: a row for each partition and dimension is added up by Spark."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for b in batches:
            _, x = integers(b.column(1), width, scale, offset)
            n, sums = n + len(x), [a + s for a, s in zip(sums, exact_sums(x))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(s) for s in sums], EXACT)], names=["pos", "n", "s"])

    found = _by_batch(rows, "pos int, n long, s decimal(38,0)", make).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("pos").collect()  # a row for each dimension
    return Centre(found[0]["n"], [int(r["s"]) for r in found]) if found else Centre(0, [0] * width)


def merged_triangle(rows: DataFrame, at: Centre, scale: int, offset: int) -> np.ndarray:
    """R of all centred rows."""
    width = len(at.sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, block = np.zeros((0, width)), max(width, (1 << 20) // max(width, 1))
        for b in batches:
            _, x = integers(b.column(1), width, scale, offset)
            for i in range(0, len(x), block):
                r = triangle(r, at.rows(x[i : i + block]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending")])
        r = np.zeros((0, width))
        for raw in group.column("r").to_pylist():
            r = triangle(r, np.frombuffer(raw).reshape(-1, width))
        return pa.table([pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    found = materialize(_by_batch(rows, "part long, r binary", reduce_rows), "triangles")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        found = materialize(found.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, "part long, r binary"), "triangles")
    last = found.first()  # one triangle
    return np.frombuffer(last["r"]).reshape(-1, width)


def identity_error(rows: DataFrame, at: Centre, found: Axes, scale: int, offset: int) -> float:
    """The largest entry of what parts the whitened vectors' covariance from the identity, over directions that have variance.

    Each partition centres its own rows before it multiplies; Spark adds up their moments, a row for each pair of components.
    """
    use = np.flatnonzero(found.values > 0)
    k, width = len(use), len(at.sums)
    upper = np.triu_indices(k)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            _, x = integers(b.column(1), width, scale, offset)
            if len(x):
                w = found.whiten(at.rows(x))[:, use]
                m = w.mean(axis=0)
                off, total = m - mean, n + len(w)
                scatter += (w - m).T @ (w - m) + np.outer(off, off) * (n * len(w) / total)
                mean, n = mean + off * (len(w) / total), total
        if n:
            cells = np.concatenate([mean * n, (scatter + n * np.outer(mean, mean))[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "value"])

    if not k:
        return 0.0
    sums = np.zeros(k + len(upper[0]))
    for r in _by_batch(rows, "cell int, value double", make).groupBy("cell").agg(F.sum("value").alias("value")).collect():  # pairs of components
        sums[r["cell"]] = r["value"] / at.n
    mean = sums[:k]
    return float(np.abs(sums[k:] - (np.outer(mean, mean) + np.eye(k))[upper]).max())


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, top: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, ``WHITENED``) for each remaining row of (vec_id, embedding) and each of the first ``top`` components.

    Entries count as x = floor(scale * c) + offset. Rows go that are null, that hold nulls or numbers that aren't finite
    (or beyond 2^56: they have no 64-bit x), and those whose length isn't that of most remaining rows (of equals, the
    greater). A null vec_id stays; repeated rows each have their rows; other columns are left behind. No row, or only empty
    vectors: no result. A component whose eigenvalue is zero but for rounding has a null ``whitened``, and is left out of
    ``identity_error``; without any variance ``explained`` is null. A ``deviation`` that doesn't fit into 64 bits is null.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    key = dict(vectors.dtypes)["vec_id"]
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))  # NaN is greater than any number
    common = rows.where(finite).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    schema = f"vec_id {key}, {WHITENED}"
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["width"]
    at = centre(rows, width, scale, offset)
    found = axes(merged_triangle(rows, at, scale, offset), at.n, top)
    error = identity_error(rows, at, found, scale, offset)
    k = len(found.values)
    explained = [float(e / found.trace) if found.trace > 0 else None for e in found.values]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = integers(b.column(1), width, scale, offset)
            if not len(own):
                continue
            off = at.deviations(x)
            most = int(np.abs(off).max())
            squares = (off if most * most * width < 1 << 62 else off.astype(object)) ** 2
            sums = [int(s) if s < 1 << 63 else None for s in squares.sum(axis=1)]
            w = found.whiten(off.astype(np.float64) / at.n).ravel()
            each = np.repeat(np.arange(len(own)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(own[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(each), at.n)),
                    pa.array(sums, pa.int64()).take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(explained * len(own), pa.float64()),
                    pa.array(np.full(len(each), error)),
                ],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    return _by_batch(rows, schema, make)
