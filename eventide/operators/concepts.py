"""Concepts: units of an activation table, thresholds, binary targets, their metrics, trees, linear concept vectors, scores.

Activations are (row_id, activation array); units are its positions from 0 on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TreeConfig
from ..functions.arrays import cosine, dot, l1, squared_distance, zeros
from ..sources.sinks import exists
from . import separators, trees
from .order import medians


def by_unit(activations: DataFrame, row_id: str = "row_id", column: str = "activation") -> DataFrame:
    """(row_id, idx, act) of every row and unit."""
    return activations.select(row_id, F.posexplode(column).alias("idx", "act"))


def thresholds(activations: DataFrame, support: int = 50, row_id: str = "row_id", column: str = "activation") -> DataFrame:
    """(idx, n_positive, threshold): the exact median of a unit's positive activations, if it has ``support`` of them."""
    positive = by_unit(activations, row_id, column).where("act > 0")
    found = medians(positive.select("idx", "act"), "idx", "act")
    return found.select("idx", F.col("n").alias("n_positive"), F.col("median").alias("threshold")).where(F.col("n_positive") >= support)


def binarise(activations: DataFrame, limits: DataFrame, row_id: str = "row_id", column: str = "activation") -> DataFrame:
    """(row_id, idx, y): 1 where a unit is strictly above its threshold; units without a threshold have no rows."""
    rows = by_unit(activations, row_id, column).join(limits.select("idx", "threshold"), "idx")
    return rows.select(row_id, "idx", (F.col("act").cast("double") > F.col("threshold")).cast("int").alias("y"))


def useful_units(train: DataFrame, test: DataFrame) -> DataFrame:
    """(idx): units with a positive both in train and in test targets (idx, y)."""
    some = lambda rows: rows.groupBy("idx").agg(F.sum("y").alias("n")).where("n > 0").select("idx")
    return some(train).join(some(test), "idx")


def binary_metrics(rows: DataFrame, keys: tuple[str, ...] = ("idx",), y: str = "y", guess: str = "guess") -> DataFrame:
    """(keys, n, accuracy, recall, f1) of 0/1 columns; a measure without anything to divide by is 0."""
    a, b = F.col(y) == 1, F.col(guess) == 1
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(a == b).alias("right"))
    return _measures(own, keys)


def _measures(counts: DataFrame, keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    part = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    return counts.select(*keys, "n", part(F.col("right"), F.col("n")).alias("accuracy"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def reconstruction_report(rows: DataFrame, original: str = "x", encoded: str = "h", decoded: str = "xhat") -> DataFrame:
    """(mean_cosine, loss_percent, mean_zeros) over all rows: how alike, 100 times what is missing, zeros in a code."""
    found = rows.agg(F.avg(cosine(F.col(original), F.col(decoded))).alias("mean_cosine"), F.avg(zeros(F.col(encoded))).alias("mean_zeros"))
    return found.select("mean_cosine", ((1 - F.col("mean_cosine")) * 100).alias("loss_percent"), "mean_zeros")


def loss_terms(rows: DataFrame, width: int, alpha: float, original: str = "x", encoded: str = "h", decoded: str = "xhat") -> DataFrame:
    """(reconstruction, sparsity, loss): squared error over the width, alpha times the sum of the codes, both over all rows."""
    found = rows.agg((F.sum(squared_distance(F.col(decoded), F.col(original))) / width).alias("reconstruction"), (alpha * F.sum(l1(F.col(encoded)))).alias("sparsity"))
    return found.select("*", (F.col("reconstruction") + F.col("sparsity")).alias("loss"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


TREES = trees.TREES


def fit_trees(features: DataFrame, targets: DataFrame, units: DataFrame, config: TreeConfig) -> DataFrame:
    """``TREES`` of each of ``units`` (idx): the tree and the settings with the best cross-validated f1, all grown together.

    Features are (row_id, features array), targets (row_id, idx, y); rows without either play no part.
    """
    grid = config.grid()
    folds = config.folds if len(grid) > 1 else 1
    return features.sparkSession.createDataFrame(trees.grown(trees.packed(features, targets, units, folds), grid, folds), TREES)


def tree_splits(found: DataFrame) -> DataFrame:
    """(idx, place, feature, limit, n, positive, gain) of every test in ``TREES``; place is the way to it from the root, L for at most the limit."""
    columns = ("place", "feature", "limit", "n", "positive", "gain")
    return found.select("idx", F.explode(F.arrays_zip(*columns)).alias("s")).select("idx", *[f"s.{c}" for c in columns]).where("feature >= 0")


def saved_trees(features: DataFrame, targets: DataFrame, units: DataFrame, config: TreeConfig, path: str) -> DataFrame:
    """:func:`fit_trees`, but units whose tree is at ``path`` aren't fitted again, and those that are fitted go there.

    The parameters' fingerprint is part of the path, so trees of another grid are never taken.
    """
    spark = features.sparkSession
    path = f"{path.rstrip('/')}/{config.fingerprint()}"
    if exists(spark, path):
        units = units.join(spark.read.schema(TREES).parquet(path).select("idx"), "idx", "left_anti")
    missing = [r["idx"] for r in units.select("idx").distinct().orderBy("idx").collect()]  # units, not rows
    for i in range(0, len(missing), 64):  # a run that breaks off keeps what it has
        fit_trees(features, targets, units.where(F.col("idx").isin(missing[i : i + 64])), config).write.mode("append").parquet(path)
    return spark.read.schema(TREES).parquet(path) if exists(spark, path) else spark.createDataFrame([], TREES)


def unit_trees(features: DataFrame, targets: DataFrame, test_features: DataFrame, test_targets: DataFrame, config: TreeConfig, path: str | None = None) -> tuple[DataFrame, dict[int, trees.UnitTree]]:
    """Metrics (idx, n, accuracy, recall, f1, kept) on the test rows and the models, of a tree for each useful unit.

    Features are (row_id, features array), targets (row_id, idx, y). Trees are chosen over the grid of ``config`` by
    cross-validated f1, many units at a time; kept: f1 of ``least_f1`` or more. With ``path`` trees are kept there.
    """
    units = useful_units(targets, test_targets)
    found = fit_trees(features, targets, units, config) if path is None else saved_trees(features, targets, units, config, path).join(units, "idx", "left_semi")
    models = {r["idx"]: trees.UnitTree(r["feature"], r["limit"], r["left"], r["right"], r["value"]) for r in found.collect()}  # a few nodes for each unit
    return guess_metrics(test_features, test_targets, models).withColumn("kept", F.col("f1") >= config.least_f1), models


def guess_metrics(features: DataFrame, targets: DataFrame, models: dict[int, trees.UnitTree]) -> DataFrame:
    """:func:`binary_metrics` by unit of what ``models`` guess from features (row_id, features) of targets (row_id, idx, y).

    A row's targets meet its features once, and tasks count. Files of targets are a hundredth of what they are in memory,
    so Spark, which goes by the files, would send all rows of a large table through the driver: both sides are shuffled.
    """
    shared = features.sparkSession.sparkContext.broadcast(models)
    marks = targets.groupBy("row_id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y"))).alias("marks"))
    own = features.select("row_id", "features").join(marks.hint("merge"), "row_id").select("features", "marks")
    names = ("n", "tp", "fp", "fn", "right")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            x, flat = _matrix(b.column(0)), b.column(1).flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            idx, y = (flat.field(i).to_numpy() for i in (0, 1))
            order = np.argsort(idx, kind="stable")
            for unit, tree in shared.value.items():
                at = order[slice(*np.searchsorted(idx[order], [unit, unit + 1]))]
                if len(at):
                    one, none, yes = y[at] == 1, y[at] == 0, tree.predict(x[row[at]]) == 1
                    found[unit] = found.get(unit, 0) + np.array([len(at), (one & yes).sum(), (none & yes).sum(), (one & ~yes).sum(), (one & yes).sum() + (none & ~yes).sum()])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([int(c[i]) for c in found.values()], pa.int64()) for i in range(len(names)))], names=["idx", *names])

    counts = own.mapInArrow(count, "idx int, " + ", ".join(f"{c} long" for c in names))
    return _measures(counts.groupBy("idx").agg(*[F.sum(c).alias(c) for c in names]))


def logistic(rows: DataFrame, iterations: int, features: str = "features", label: str = "y", weight_of_data: float = 1.0):
    """A logistic model with an L2 penalty of 1 / (``weight_of_data`` * rows), features as they are."""
    own = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    n = max(rows.count(), 1)
    return LogisticRegression(maxIter=iterations, tol=1e-9, regParam=1 / (weight_of_data * n), elasticNetParam=0.0, standardization=False).fit(own)


def separators_of(embeddings: DataFrame, targets: DataFrame, units: list[int] | None = None, iterations: int = 100) -> DataFrame:
    """(idx, cav, intercept): a linear separator of each unit's targets among embeddings (row_id, embedding), by all of their rows.

    The penalty is |cav|^2 / 2. Each Newton step of all units is one job; rows without a vector or a target play no part.
    """
    wanted = targets if units is None else targets.where(F.col("idx").isin(units))
    found = separators.newton(separators.packed(embeddings, wanted), iterations)
    return embeddings.sparkSession.createDataFrame([(u, t[:-1].tolist(), float(t[-1])) for u, t in found.items()], "idx int, cav array<double>, intercept double")  # a model


def concept_vectors(embeddings: DataFrame, targets: DataFrame, units: list[int] | None = None, iterations: int = 100) -> DataFrame:
    """(idx, cav): the normal of a linear separator of each unit's targets among embeddings (row_id, embedding)."""
    return separators_of(embeddings, targets, units, iterations).select("idx", "cav")


def separator_slopes(embeddings: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """(idx, pos, slope): what is left of the slope of each separator's loss; 0 at a solution. The intercept's comes last.

    Summed up by Spark over all rows, so it doesn't depend on how the separators (idx, cav, intercept) were found.
    """
    rows = embeddings.join(targets.hint("merge"), "row_id").join(found, "idx")  # files of targets look small enough to broadcast
    off = 1 / (1 + F.exp(-(dot(F.col("embedding").cast("array<double>"), F.col("cav")) + F.col("intercept")))) - F.col("y")
    cells = rows.select("idx", "cav", off.alias("off"), F.posexplode(F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(1.0)))).alias("pos", "x"))
    return cells.groupBy("idx", "pos").agg((F.sum(F.col("off") * F.col("x")) + F.first(F.coalesce(F.try_element_at("cav", F.col("pos") + 1), F.lit(0.0)))).alias("slope"))


def surrogate_gradient(embeddings: DataFrame, predictions: DataFrame, iterations: int = 1000) -> DataFrame:
    """(gradient): coefficients of a linear stand-in for a classifier's predictions (row_id, y), in the embeddings' space."""
    model = logistic(embeddings.join(predictions, "row_id"), iterations, "embedding")
    return embeddings.sparkSession.createDataFrame([([float(x) for x in model.coefficients],)], "gradient array<double>")


def concept_scores(cavs: DataFrame, gradient: DataFrame) -> DataFrame:
    """(idx, score): a concept's derivative along the gradient, a table of one row."""
    return cavs.crossJoin(F.broadcast(gradient.limit(1))).select("idx", dot(F.col("cav"), F.col("gradient")).alias("score"))


def predict(model, rows: DataFrame, features: str = "features") -> DataFrame:
    """(row_id, prediction, probability) by a fitted classifier; probability is that of class 1."""
    own = rows.select("row_id", array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    return model.transform(own).select("row_id", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))


class Classifier(Protocol):
    """What the concepts explain: fitted to (row_id, features, label), gives (row_id, prediction, probability)."""

    def fit_predict(self, train: DataFrame, rows: DataFrame) -> DataFrame: ...


class LogisticClassifier:
    """A classifier where no pretrained model is at hand."""

    def __init__(self, iterations: int = 100):
        self.iterations = iterations

    def fit_predict(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        return predict(logistic(train, self.iterations, "features", "label"), rows)
