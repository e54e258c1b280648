"""Small decision trees for all units of an activation table at once, grown from class histograms that Spark adds up.

Rows are written once as numbers of bins and marks of all units. A job answers for all nodes that any tree has newly opened:
tasks count classes by (node, feature, bin), Spark adds the counts up and picks each node's best split for every class
weight and impurity; a node's answer comes to the driver as one row. Trees of different settings and folds that reach the
same node share it. A tree makes one split a job, best first, so there are as many jobs as splits in the largest tree.
Rows that a fold leaves out are counted in the leaves too: cross-validated f1 needs no job of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .cohort import in_hash_order
from .order import quantile_limits

BINS = 64
#: Rows of a block that a task counts at once, and entries of a task for each cell, at least.
BLOCK, SPREAD = 1 << 15, 8
TREES = (
    "idx int, depth int, impurity string, balanced boolean, cv_f1 double, feature array<int>, limit array<double>, left array<int>, right array<int>, value array<int>, "
    "place array<string>, n array<bigint>, positive array<bigint>, gain array<double>"
)


class UnitTree(NamedTuple):
    """Nodes from the root on: the feature tested (-1: a leaf), its limit, the nodes for at most it and for more, the class."""

    feature: list[int]
    limit: list[float]
    left: list[int]
    right: list[int]
    value: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, feature = np.zeros(len(x), np.int64), np.array(self.feature)
        limit, left, right = np.array(self.limit), np.array(self.left), np.array(self.right)
        rows = np.arange(len(x))
        while True:
            open_ = rows[feature[at] >= 0]
            if not len(open_):
                return np.array(self.value)[at]
            here = at[open_]
            at[open_] = np.where(x[open_, feature[here]] <= limit[here], left[here], right[here])

    @property
    def toDebugString(self) -> str:  # noqa: N802  as Spark's own trees have it
        lines = ["UnitTree"]

        def write(node: int, depth: int) -> None:
            pad = " " * (2 + depth)
            if self.feature[node] < 0:
                lines.append(f"{pad}Predict: {float(self.value[node])}")
                return
            lines.append(f"{pad}If (feature {self.feature[node]} <= {self.limit[node]})")
            write(self.left[node], depth + 1)
            lines.append(f"{pad}Else (feature {self.feature[node]} > {self.limit[node]})")
            write(self.right[node], depth + 1)

        write(0, 0)
        return "\n".join(lines)


class Packed(NamedTuple):
    """(codes, marks) of every row: a byte for each feature's bin; a byte for each unit, 2 * fold + y, 255 without a target."""

    rows: DataFrame
    units: list[int]
    limits: list[np.ndarray]


def packed(features: DataFrame, targets: DataFrame, units: DataFrame, folds: int) -> Packed:
    """Features (row_id, features array) and targets (row_id, idx, y) of ``units`` (idx), a row for each row_id in both.

    Folds are dealt by unit and class in the order of a hash of row_id. A feature that is null or NaN counts as its greatest.
    """
    own = targets.join(units.select("idx").distinct(), "idx", "left_semi").select(F.col("row_id").alias("patient_id"), F.col("idx").cast("int").alias("idx"), F.col("y").cast("int").alias("y"))
    ranked = own.withColumn("rn", F.lit(1)) if folds < 2 else in_hash_order(own, F.md5(F.col("patient_id").cast("string").cast("binary")), ("idx", "y"))
    marks = ranked.groupBy(F.col("patient_id").alias("row_id")).agg(F.collect_list(F.struct("idx", ((F.col("rn") - 1) % max(folds, 1) * 2 + F.col("y")).cast("int").alias("mark"))).alias("marks"))
    known = features.select("row_id", F.col("features").cast("array<double>").alias("features"))
    joined = materialize(known.join(marks, "row_id"), "marked")
    names = [r["idx"] for r in joined.select(F.explode("marks.idx").alias("idx")).distinct().orderBy("idx").collect()]  # units, not rows
    cells = joined.select(F.posexplode("features").alias("pos", "v")).where("v is not null and not isnan(v)")
    found = {r["pos"]: np.array([*r["limits"], *([np.inf] if r["cut"] else [])]) for r in quantile_limits(cells, "pos", "v", BINS).collect()}  # BINS numbers for each feature
    width = joined.agg(F.max(F.size("features"))).first()[0] or 0
    limits = [found.get(i, np.array([np.inf])) for i in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.array(names)
        for b in batches:
            m = b.num_rows
            x = _filled(b.column(0), np.full((m, width), np.nan))
            codes = np.empty((m, width), np.uint8)
            for f, cuts in enumerate(limits):
                codes[:, f] = np.minimum(np.searchsorted(cuts, x[:, f]), len(cuts) - 1)
            own, flat = np.full((m, len(index)), 255, np.uint8), b.column(1).flatten()
            row = np.repeat(np.arange(m), np.diff(b.column(1).offsets.to_numpy()))
            own[row, np.searchsorted(index, flat.field(0).to_numpy())] = flat.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in own], pa.binary())], names=["codes", "marks"])

    rows = materialize(joined.select("features", "marks").mapInArrow(run, "codes binary, marks binary"), "packed")
    # each task's counts fill up to all cells of a node: few rows aren't spread over many tasks
    enough = rows.count() * width // (SPREAD * max(sum(map(len, limits)), 1))
    return Packed(rows.coalesce(max(enough, 1)), names, limits)


def _filled(column: pa.Array, out: np.ndarray) -> np.ndarray:
    """A list column's numbers, row by row, in the first columns of ``out``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


class Node(NamedTuple):
    """Rows of a unit, without those of fold ``k`` (-1: of none), that pass the tests (feature, bin, 0: at most, 1: more)."""

    unit: int
    k: int
    path: tuple[tuple[int, int, int], ...]

    def child(self, feature: int, cut: int, side: int) -> Node:
        return self._replace(path=tuple(sorted({*self.path, (feature, cut, side)})))


class Split(NamedTuple):
    gain: float
    feature: int
    cut: int
    n: int
    positive: int


class Answer(NamedTuple):
    """Of a node: rows and positive ones, the same of the rows left out, the best split by (balanced, impurity) if one is allowed."""

    n: int
    positive: int
    held: int
    held_positive: int
    best: dict[tuple[bool, str], Split]


def _impurity(positive: Column, total: Column, kind: str) -> Column:
    """Of a node, times its weight."""
    p = F.coalesce(F.try_divide(positive, total), F.lit(0.0))
    if kind == "gini":
        return 2 * p * (1 - p) * total
    part = lambda q: F.when(q > 0, q * F.log2(q)).otherwise(0.0)
    return -(part(p) + part(1 - p)) * total


def histograms(data: Packed, nodes: list[tuple[Node, bool]]) -> DataFrame:
    """(node, feature, bin, n, positive) of each of ``nodes``, numbered as they come: class counts by bin if asked for.

    Feature -1 has the counts of all rows, -2 those of the rows left out. Empty cells have no row.
    """
    sizes = np.array([len(v) for v in data.limits], np.int64)
    starts = np.cumsum(sizes) - sizes
    shared = data.rows.sparkSession.sparkContext.broadcast(nodes)  # the open ends of trees of a few leaves
    units = {u: i for i, u in enumerate(data.units)}

    def counted(codes: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        feature_of, bin_of = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes)
        cells = codes + starts
        for number, (node, whole) in enumerate(shared.value):
            mark = marks[:, units[node.unit]]
            inside = mark != 255
            for feature, cut, side in node.path:
                inside &= (codes[:, feature] > cut) == bool(side)
            y, held = (mark & 1).astype(bool), (mark >> 1) == node.k if node.k >= 0 else np.zeros(len(mark), bool)
            own, out = inside & ~held, inside & held
            parts = [(np.array([-1, -2]), np.zeros(2, np.int64), np.array([own.sum(), out.sum()]), np.array([(own & y).sum(), (out & y).sum()]))]
            if whole:
                n, positive = (np.bincount(cells[at].ravel(), minlength=len(feature_of)) for at in (own, own & y))
                held_cells = np.flatnonzero(n)
                parts.append((feature_of[held_cells], bin_of[held_cells], n[held_cells], positive[held_cells]))
            f, b, n, positive = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), number, np.int32)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n), pa.array(positive)], names=["node", "feature", "bin", "n", "positive"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for b in batches:
            kept.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield from counted(*_arrays(kept))
                kept, rows = [], 0
        if rows:
            yield from counted(*_arrays(kept))

    found = data.rows.mapInArrow(run, "node int, feature int, bin int, n long, positive long")
    return found.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(x for b in batches for x in b.column(c).to_pylist()), np.uint8).reshape(sum(b.num_rows for b in batches), -1) for c in (0, 1))


def best_splits(counts: DataFrame, weights: DataFrame, kinds: list[tuple[bool, str]], min_rows: int) -> DataFrame:
    """(node, n, positive, held, held_positive, s0, s1, ...): each node's counts and its best split for each of ``kinds``.

    ``weights`` are (node, w0, w1) of the classes where they are balanced. Gains are compared to nine decimals; of equals the
    first feature's least bin is taken. A side has ``min_rows`` rows at least.
    """
    totals = counts.where("feature < 0").groupBy("node").agg(*[F.sum(F.when(F.col("feature") == f, F.col(c)).otherwise(0)).alias(name) for f, c, name in ((-1, "n", "n"), (-1, "positive", "positive"), (-2, "n", "held"), (-2, "positive", "held_positive"))])
    whole = W.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cuts = counts.where("feature >= 0").select("node", "feature", "bin", *[F.sum(c).over(w).alias(f"{c}_{k}") for c in ("n", "positive") for k, w in (("all", whole), ("low", upto))])
    cuts = cuts.where((F.col("n_low") >= min_rows) & (F.col("n_all") - F.col("n_low") >= min_rows)).join(weights, "node")
    best = []
    for i, (balanced, kind) in enumerate(kinds):
        w0, w1 = (F.col("w0"), F.col("w1")) if balanced else (F.lit(1.0), F.lit(1.0))
        low, every = ((w1 * F.col(f"positive_{k}"), w1 * F.col(f"positive_{k}") + w0 * (F.col(f"n_{k}") - F.col(f"positive_{k}"))) for k in ("low", "all"))
        gain = F.round(_impurity(*every, kind) - _impurity(*low, kind) - _impurity(every[0] - low[0], every[1] - low[1], kind), 9)
        best.append(F.max(F.when(gain > 1e-12, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("n_low").alias("n"), F.col("positive_low").alias("positive")))).alias(f"s{i}"))
    return totals.join(cuts.groupBy("node").agg(*best), "node", "left")


class Growing:
    """One tree on its way: of a unit, for a fold and settings."""

    def __init__(self, root: Node, settings: dict, answers: dict[Node, Answer]):
        self.settings, self.answers = settings, answers
        self.kind = (settings["balanced"], settings["impurity"])
        whole = answers[root]
        self.weights = class_weights(whole.n, whole.positive) if settings["balanced"] else (1.0, 1.0)
        self.nodes: list[Node] = []
        self.tree = UnitTree([], [], [], [], [])
        self.place, self.n, self.positive, self.gain = [], [], [], []
        self.depth: list[int] = []
        self.heap: list[tuple[float, int]] = []
        self.offered, self.leaves = 0, 1
        self._leaf(root, 0, "", whole.n, whole.positive)

    def _leaf(self, node: Node, depth: int, place: str, n: int, positive: int) -> int:
        self.nodes.append(node)
        self.depth.append(depth)
        for column, v in zip((*self.tree, self.place, self.n, self.positive, self.gain), (-1, 0.0, -1, -1, int(self.weights[1] * positive > self.weights[0] * (n - positive)), place, n, positive, 0.0)):
            column.append(v)
        return len(self.nodes) - 1

    def may_split(self, at: int) -> bool:
        s, n, positive = self.settings, self.n[at], self.positive[at]
        return self.leaves < s["max_leaves"] and self.depth[at] < s["max_depth"] and n >= 2 * s["min_rows"] and 0 < positive < n

    def offer(self) -> None:
        """Splits of the nodes that came last, now that they are answered."""
        for at in range(self.offered, len(self.nodes)):
            found = self.answers[self.nodes[at]].best.get(self.kind) if self.may_split(at) else None
            if found:
                heapq.heappush(self.heap, (-found.gain, at))
        self.offered = len(self.nodes)

    def split(self, limits: list[np.ndarray]) -> list[tuple[Node, bool]]:
        """The best split is made; which nodes must be answered, and whether with their bins."""
        if not self.heap or self.leaves >= self.settings["max_leaves"]:
            return []
        _, at = heapq.heappop(self.heap)
        node, s = self.nodes[at], self.answers[self.nodes[at]].best[self.kind]
        self.tree.feature[at], self.tree.limit[at], self.gain[at] = s.feature, float(limits[s.feature][s.cut]), s.gain
        self.leaves += 1
        new = []
        for side, column in ((0, self.tree.left), (1, self.tree.right)):
            n, positive = (s.n, s.positive) if side == 0 else (self.n[at] - s.n, self.positive[at] - s.positive)
            column[at] = self._leaf(node.child(s.feature, s.cut, side), self.depth[at] + 1, self.place[at] + "LR"[side], n, positive)
            new.append(column[at])
        return [(self.nodes[i], self.may_split(i)) for i in new if self.may_split(i) or node.k >= 0]

    def held_f1(self) -> float | None:
        """f1 of the rows left out; None without any."""
        guess = [(self.answers[self.nodes[i]], v) for i, (f, v) in enumerate(zip(self.tree.feature, self.tree.value)) if f < 0]
        hit = sum(a.held_positive for a, v in guess if v)
        wrong = sum(a.held - a.held_positive if v else a.held_positive for a, v in guess)
        return None if not sum(a.held for a, _ in guess) else 2 * hit / (2 * hit + wrong) if hit else 0.0


def class_weights(n: int, positive: int) -> tuple[float, float]:
    """Of the classes 0 and 1, where they are balanced."""
    return n / (2 * max(n - positive, 1)), n / (2 * max(positive, 1))


def answered(data: Packed, nodes: dict[Node, bool], answers: dict[Node, Answer], kinds: list[tuple[bool, str]], min_rows: int) -> None:
    """Puts the answers of ``nodes`` into ``answers``: one job, one row a node."""
    asked = sorted(nodes.items())
    spark = data.rows.sparkSession
    weights = []
    for i, (node, _) in enumerate(asked):
        root = answers.get(Node(node.unit, node.k, ()))
        weights.append((i, *(class_weights(root.n, root.positive) if root else (1.0, 1.0))))
    found = best_splits(histograms(data, asked), spark.createDataFrame(weights, "node int, w0 double, w1 double"), kinds, min_rows)
    rows = {r["node"]: r for r in found.collect()}  # a row for each open node
    for i, (node, _) in enumerate(asked):
        r = rows.get(i)
        best = {} if r is None else {kind: Split(s["gain"], -s["f"], -s["b"], s["n"], s["positive"]) for j, kind in enumerate(kinds) if (s := r[f"s{j}"]) is not None}
        answers[node] = Answer(0, 0, 0, 0, {}) if r is None else Answer(r["n"], r["positive"], r["held"], r["held_positive"], best)


def grown(data: Packed, grid: list[dict], folds: int) -> list[tuple]:
    """``TREES`` of every unit: of all settings of ``grid`` that with the best mean f1 over the folds (the first of equals)."""
    if not data.units:
        return []
    kinds = list(dict.fromkeys((s["balanced"], s["impurity"]) for s in grid))
    least = min(s["min_rows"] for s in grid)
    if {s["min_rows"] for s in grid} != {least}:
        raise ValueError("all settings of a grid take the same min_rows")
    answers: dict[Node, Answer] = {}
    roots = [Node(u, k, ()) for u in data.units for k in (range(-1, folds) if len(grid) > 1 else (-1,))]
    for whole in (False, True):  # the classes' weights, then the first splits
        answered(data, dict.fromkeys(roots, whole), answers, kinds, least)
    trees = {(r.unit, r.k, i): Growing(r, s, answers) for r in roots for i, s in enumerate(grid)}
    binned = set(roots)
    while True:
        asked: dict[Node, bool] = {}
        for t in trees.values():
            t.offer()
            for node, whole in t.split(data.limits):
                if node not in answers or whole and node not in binned:
                    asked[node] = asked.get(node, False) or whole
        if not asked and not any(t.heap and t.leaves < t.settings["max_leaves"] for t in trees.values()):
            break
        if asked:
            answered(data, asked, answers, kinds, least)
            binned |= {node for node, whole in asked.items() if whole}
    out = []
    for u in data.units:
        scores = [0.0] * len(grid)
        if len(grid) > 1:
            for i in range(len(grid)):
                scores[i] = sum((trees[u, k, i].held_f1() or 0.0) / folds for k in range(folds))
        i = int(np.argmax(np.round(scores, 9)))
        t, s = trees[u, -1, i], grid[i]
        out.append((u, s["max_depth"], s["impurity"], s["balanced"], scores[i], *t.tree, t.place, t.n, t.positive, t.gain))
    return out
