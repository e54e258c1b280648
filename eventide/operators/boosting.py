"""Boosted trees grown leaf by leaf over sparse rows, for the gains of their features.

Rows hold the counts that aren't zero. Tasks of a barrier stage keep their rows through all rounds and sum up histograms of
gradients, Hessians and rows by feature and bin; what zeros have is what a node has beyond the rest. Each step splits the
leaf of most gain, adds up the histogram of its smaller child and subtracts it from the parent's for the other.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BoostingConfig
from ..sources.scratch import materialize
from .matrix import KEYS, long_counts
from .order import quantile_limits
from .together import Group, tasks_for, trained

SPLITS = "round int, place string, code int, cut int, gain double, n bigint"


def sparse_rows(events: DataFrame, candidates: DataFrame, terminal: str) -> DataFrame:
    """(patient_id, year, codes, counts, label) of each entity-period that has a candidate (event, code) or the terminal event."""
    cells = long_counts(events).join(candidates, "event", "left").where((F.col("code").isNotNull() | (F.col("event") == terminal)) & (F.col("n") > 0))
    cell = F.when(F.col("code").isNotNull(), F.struct("code", "n"))
    own = cells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max((F.col("event") == terminal).cast("int")).alias("label"))
    return own.select(*KEYS, F.col("cells.code").alias("codes"), F.col("cells.n").alias("counts"), "label")


class Sparse(NamedTuple):
    """Rows as cells: ``starts`` of each row's, cell numbers, labels; a feature's cells are its bins, the first for zero."""

    starts: np.ndarray
    cells: np.ndarray
    y: np.ndarray
    first: np.ndarray
    #: Of all cells, the feature; and by feature, where its rows are found.
    feature: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], limits: list[np.ndarray]) -> Sparse:
        sizes = np.array([1 + len(v) for v in limits], np.int64)
        first = np.cumsum(sizes) - sizes
        lengths, cells, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            codes, n = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (0, 1))
            bins = np.zeros(len(codes), np.int64)
            for code in np.unique(codes):
                own = codes == code
                bins[own] = 1 + np.minimum(np.searchsorted(limits[code], n[own]), len(limits[code]) - 1)
            lengths.append(np.diff(b.column(0).offsets.to_numpy()))
            cells.append(first[codes] + bins)
            labels.append(b.column(2).to_numpy().astype(np.int64))
        return cls(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(cells), np.concatenate(labels), first, np.repeat(np.arange(len(limits)), sizes))

    def histogram(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` (columns by row) over cells that aren't zeros', then the totals of ``rows``."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        own = self.cells[at]
        each = np.repeat(rows, lengths)
        return np.stack([np.append(np.bincount(own, weights=v[each], minlength=len(self.feature)), v[rows].sum()) for v in values])

    def rows_above(self, cell: int) -> np.ndarray:
        """Which rows have a greater bin of the cell's feature."""
        out = np.zeros(len(self.y), bool)
        own = (self.cells > cell) & (self.feature[self.cells] == self.feature[cell])
        out[np.searchsorted(self.starts, np.flatnonzero(own), side="right") - 1] = True
        return out


class Best(NamedTuple):
    gain: float
    cell: int
    left: np.ndarray  # gradient, Hessian, rows


def best_split(histogram: np.ndarray, first: np.ndarray, feature: np.ndarray, config: BoostingConfig) -> Best | None:
    """The cell after which a cut gains most, to nine decimals; of equals the first feature's least bin."""
    cells, total = histogram[:, :-1].copy(), histogram[:, -1:]
    if not cells.shape[1]:
        return None
    cells[:, first] += total - np.add.reduceat(cells, first, axis=1)
    upto = np.cumsum(cells, axis=1)
    left = upto - (upto[:, first] - cells[:, first])[:, feature]
    right = total - left
    last = np.append(feature[1:] != feature[:-1], True)
    fits = ~last & (np.rint(np.minimum(left[2], right[2])) >= config.min_rows) & (np.minimum(left[1], right[1]) >= config.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, np.round(left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], 9), -1.0)
    at = int(gain.argmax())
    return Best(float(gain[at]), at, left[:, at]) if gain[at] > 0 else None


class Leaf(NamedTuple):
    place: str
    rows: np.ndarray
    histogram: np.ndarray
    best: Best | None


def boost(data: Sparse, config: BoostingConfig, group: Group) -> list[tuple]:
    """``SPLITS`` of all rounds: logistic loss, positives weighted by negatives over positives, scores from the share of positives on."""
    n, positive = group.sum(np.array([len(data.y), data.y.sum()], np.float64))
    weight = np.where(data.y == 1, (n - positive) / positive, 1.0)
    share = np.clip(positive / n, 1e-15, 1 - 1e-15)
    score, out = np.full(len(data.y), np.log(share / (1 - share))), []

    def leaf(place: str, rows: np.ndarray, histogram: np.ndarray) -> Leaf:
        return Leaf(place, rows, histogram, best_split(histogram, data.first, data.feature, config))

    for turn in range(config.rounds):
        p = 1 / (1 + np.exp(-score))
        values = np.stack([weight * (p - data.y), weight * p * (1 - p), np.ones(len(p))])
        every = np.arange(len(p))
        leaves = [leaf("", every, group.sum(data.histogram(every, values)))]
        heap = [(-leaves[0].best.gain, 0)] if leaves[0].best else []
        n_leaves = 1
        while heap and n_leaves < config.leaves:
            _, at = heapq.heappop(heap)
            own = leaves[at]
            out.append((turn, own.place, int(data.feature[own.best.cell]), int(own.best.cell - data.first[data.feature[own.best.cell]]), own.best.gain, int(np.rint(own.histogram[2, -1]))))
            above = data.rows_above(own.best.cell)[own.rows]
            parts = own.rows[~above], own.rows[above]
            less = int(own.best.left[2] * 2 > own.histogram[2, -1])  # the side with fewer rows, over all tasks
            small = group.sum(data.histogram(parts[less], values))
            sides = (small, own.histogram - small) if less == 0 else (own.histogram - small, small)
            for rows, histogram, side in zip(parts, sides, "LR"):
                leaves.append(leaf(own.place + side, rows, histogram))
                if leaves[-1].best:
                    heapq.heappush(heap, (-leaves[-1].best.gain, len(leaves) - 1))
            leaves[at] = own._replace(rows=own.rows[:0])
            n_leaves += 1
        if n_leaves == 1:
            break  # no split gains, and none will: scores stay as they are
        for own in leaves:
            if len(own.rows):
                score[own.rows] -= config.step_size * own.histogram[0, -1] / own.histogram[1, -1]
    return out


def boosted_splits(events: DataFrame, values: list[str], terminal: str, config: BoostingConfig) -> DataFrame:
    """(round, place, event, limit, gain, n): every test of the trees, the way to it, the rows that reach it.

    ``values`` are the candidates in the order in which ties go to them. Trees have ``config.leaves`` leaves at most; counts
    are cut at ``config.max_bins`` quantiles where they have more values. Without a positive row it raises RuntimeError.
    """
    spark = events.sparkSession
    candidates = spark.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(values))], "event string, code int")
    rows = materialize(sparse_rows(events, candidates, terminal), "sparse")
    positive, cells = rows.agg(F.count_if(F.col("label") == 1), F.sum(F.size("codes"))).first()
    if not positive:
        raise RuntimeError("no positive row to rank features by")
    known = rows.select(F.explode(F.arrays_zip("codes", "counts")).alias("c")).select(F.col("c.codes").alias("code"), F.col("c.counts").alias("value"))
    found = {r["code"]: np.array([*r["limits"], *([np.inf] if r["cut"] else [])]) for r in quantile_limits(known, "code", "value", config.max_bins - 1).collect()}  # the candidates' bins
    limits = [found.get(i, np.zeros(0)) for i in range(len(set(values)))]
    tasks = config.tasks or tasks_for(cells or 0, 4, spark.sparkContext.defaultParallelism, config.task_bytes, config.task_cells)

    def train(batches: list[pa.RecordBatch], group: Group) -> pa.RecordBatch:
        made = boost(Sparse.of(batches, limits), config, group)
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in SPLITS.split(", ")])

    splits = materialize(trained(rows.select("codes", "counts", "label"), tasks, SPLITS, train), "splits")
    cuts = spark.createDataFrame([(i, [0.0, *map(float, v)]) for i, v in enumerate(limits)], "code int, limits array<double>")
    return splits.join(cuts, "code").join(candidates, "code").select("round", "place", "event", F.col("limits")[F.col("cut")].alias("limit"), "gain", "n")
