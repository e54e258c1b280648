"""Logistic separators of all units at once: each Newton step is one job in which Spark adds up Gram matrices over all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Rows that a task works on at once, sums of one unit that one task adds up, bytes of Gram matrices that a task holds.
BLOCK, FAN_IN, HELD = 1 << 14, 32, 128 << 20


class Table(NamedTuple):
    """(x, marks) of every row: its vector's doubles, then 1; a byte for each unit, 0 or 1, 255 without a target."""

    rows: DataFrame
    units: list[int]
    width: int


def packed(embeddings: DataFrame, targets: DataFrame) -> Table:
    """Embeddings (row_id, embedding) and targets (row_id, idx, y), a row for each row_id in both; null vectors play no part."""
    marks = targets.groupBy("row_id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("y").cast("int").alias("y"))).alias("marks"))
    known = embeddings.where("embedding is not null").select("row_id", F.col("embedding").cast("array<double>").alias("x"))
    joined = materialize(known.join(marks, "row_id").select("x", "marks"), "marked")
    units = [r["idx"] for r in joined.select(F.explode("marks.idx").alias("idx")).distinct().orderBy("idx").collect()]  # units, not rows
    width = (joined.agg(F.max(F.size("x"))).first()[0] or 0) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.array(units)
        for b in batches:
            x = np.array([[*v, 1.0] for v in b.column(0).to_pylist()]).reshape(b.num_rows, width)
            own, flat = np.full((b.num_rows, len(index)), 255, np.uint8), b.column(1).flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            own[row, np.searchsorted(index, flat.field(0).to_numpy())] = flat.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in own], pa.binary())], names=["x", "marks"])

    return Table(materialize(joined.mapInArrow(run, "x binary, marks binary"), "packed"), units, width)


def sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, slope and Gram matrix of a logistic model's likelihood, one after the other; they add up over rows."""
    z = x @ theta
    p = 1 / (1 + np.exp(-z))
    return np.concatenate([[np.logaddexp(0.0, z).sum() - y @ z], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


class At(NamedTuple):
    """A unit's penalised loss at a point, its largest slope there, and Newton's step from it."""

    loss: float
    slope: float
    step: np.ndarray

    @classmethod
    def of(cls, total: np.ndarray, theta: np.ndarray) -> At:
        """The penalty is |coefficients|^2 / 2; the intercept, which comes last, has none."""
        d = len(theta)
        penalty = np.ones(d)
        penalty[-1] = 0.0
        slope = total[1 : 1 + d] + penalty * theta
        return cls(float(total[0] + 0.5 * (penalty * theta * theta).sum()), float(np.abs(slope).max()), np.linalg.solve(total[1 + d :].reshape(d, d) + np.diag(penalty + 1e-12), slope))


def _tables(raw: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in raw.to_pylist()]


def evaluated(table: Table, points: dict[int, np.ndarray]) -> dict[int, At]:
    """Every unit of ``points`` at its point: one job, one row a unit."""
    index = {u: i for i, u in enumerate(table.units)}
    shared = table.rows.sparkSession.sparkContext.broadcast(points)  # coefficients
    width = table.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x, marks = (np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), -1) for c, kind in ((b.column(0).slice(at, BLOCK), "f8"), (b.column(1).slice(at, BLOCK), "u1")))
                for unit, theta in shared.value.items():
                    mark = marks[:, index[unit]]
                    own = mark != 255
                    if own.any():
                        total[unit] = total.get(unit, 0.0) + sums(x[own], mark[own].astype(float), theta)
        part = TaskContext.get().partitionId()
        for unit, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["unit", "part", "total"])

    def added(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending")])
        return pa.table([group.column("unit").slice(0, 1), pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int32()), pa.array([np.sum(_tables(group.column("total"), "f8"), axis=0).tobytes()], pa.binary())], names=["unit", "part", "total"])

    def solved(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending")])
        unit = group.column("unit")[0].as_py()
        found = At.of(np.sum(_tables(group.column("total"), "f8"), axis=0), shared.value[unit])
        return pa.table([pa.array([unit], pa.int32()), pa.array([found.loss]), pa.array([found.slope]), pa.array([found.step.tolist()], pa.list_(pa.float64()))], names=["unit", "loss", "slope", "step"])

    schema = "unit int, part int, total binary"
    parts = table.rows.mapInArrow(run, schema).groupBy("unit", F.floor(F.col("part") / FAN_IN)).applyInArrow(added, schema)
    rows = parts.groupBy("unit").applyInArrow(solved, "unit int, loss double, slope double, step array<double>").collect()  # a row for each unit
    return {r["unit"]: At(r["loss"], r["slope"], np.array(r["step"])) for r in rows}


def newton(table: Table, iterations: int, tolerance: float = 1e-9) -> dict[int, np.ndarray]:
    """Coefficients and intercept of every unit: Newton's steps, halved while the loss rises, until no slope is above ``tolerance``.

    A slope is a sum over rows; where rounding leaves more of it, a step that gains nothing any more ends the search. Units
    whose Gram matrices a task can't hold together take turns.
    """
    some = max(1, HELD // (8 * table.width * table.width))
    out: dict[int, np.ndarray] = {}
    for i in range(0, len(table.units), some):
        units = table.units[i : i + some]
        theta, best, size = {u: np.zeros(table.width) for u in units}, {}, dict.fromkeys(units, 1.0)
        tried = dict(theta)
        for _ in range(iterations):
            for u, at in evaluated(table, tried).items():
                if u not in best or at.loss < best[u].loss or at.slope < best[u].slope and at.loss <= best[u].loss + 1e-12 * abs(best[u].loss):
                    theta[u], best[u], size[u] = tried[u], at, 1.0
                else:
                    size[u] /= 2
            tried = {u: theta[u] - size[u] * best[u].step for u in tried if best[u].slope > tolerance and size[u] > 1e-6}
            if not tried:
                break
        out |= theta
    return out
