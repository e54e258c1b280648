"""Embeddings of labelled rows by networks that haven't seen them: one for each fold, fitted to the other folds' rows.

All networks train side by side in one barrier stage, which sums their slopes each epoch; another one, fitted to all rows,
is for rows that took no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EmbeddingConfig
from ..sources.scratch import materialize
from .together import Group, tasks_for, trained

MODELS = "fold int, part int, numbers array<double>"


class Network(NamedTuple):
    """Of features x: activations tanh(x w + b), and log odds of label 1 from these."""

    w: np.ndarray
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def initial(cls, features: int, config: EmbeddingConfig, fold: int) -> Network:
        r = np.random.default_rng([config.seed, fold + 1])
        return cls(r.normal(0, 1 / np.sqrt(max(features, 1)), (features, config.width)), np.zeros(config.width), r.normal(0, 1 / np.sqrt(config.width), config.width), np.zeros(1))

    def embed(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w + self.b)

    def slopes(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Of the summed logistic loss over rows; they add up."""
        h = self.embed(x)
        off = 1 / (1 + np.exp(-(h @ self.out + self.bias[0]))) - y
        back = off[:, None] * self.out * (1 - h * h)
        return Network(x.T @ back, back.sum(axis=0), h.T @ off, np.array([off.sum()]))


def fold_of(row_id: str, folds: int) -> F.Column:
    """The fold of a row, by a hash of its id."""
    return (F.conv(F.substring(F.md5(F.col(row_id).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def _features(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), width)


def _side_by_side(width: int, config: EmbeddingConfig):
    """Networks for all folds, and as fold -1 that of all rows, by full-batch Adam on rows (features, label, fold)."""

    def run(batches: list[pa.RecordBatch], group: Group) -> pa.RecordBatch:
        x = np.concatenate([np.zeros((0, width)), *(_features(b.column(0), width) for b in batches)])
        y, fold = (np.concatenate([np.zeros(0), *(b.column(i).to_numpy() for b in batches)]) for i in (1, 2))
        folds = [-1, *range(config.folds)]
        nets = [Network.initial(width, config, k) for k in folds]
        seen = [fold != k for k in folds]
        n = group.sum(np.array([own.sum() for own in seen], np.float64))
        size = sum(p.size for p in nets[0])
        flat = np.concatenate([p.ravel() for net in nets for p in net])
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        each = np.repeat(np.maximum(n, 1), size)

        def shaped(numbers: np.ndarray) -> Network:
            parts = np.split(numbers, np.cumsum([p.size for p in nets[0]])[:-1])
            return Network(*(p.reshape(q.shape) for p, q in zip(parts, nets[0])))

        for step in range(1, config.epochs + 1):
            own = [shaped(flat[i * size : (i + 1) * size]).slopes(x[s], y[s]) for i, s in enumerate(seen)]
            slope = group.sum(np.concatenate([p.ravel() for s in own for p in s])) / each + config.weight_decay * flat
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            flat = flat - config.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        rows = [(k, i, p.ravel().tolist()) for j, k in enumerate(folds) for i, p in enumerate(shaped(flat[j * size : (j + 1) * size]))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["fold", "part", "numbers"])

    return run


class FoldedEmbedder:
    """Fitted to (row_id, features, label); its own training rows are embedded by the network that left their fold out."""

    def __init__(self, config: EmbeddingConfig = EmbeddingConfig()):
        self.config, self.networks = config, {}

    def fit(self, train: DataFrame) -> FoldedEmbedder:
        """Rows without features or a label play no part; without any it raises RuntimeError."""
        config = self.config
        own = train.where("features is not null and label is not null")
        n, width = own.agg(F.count("*"), F.max(F.size("features"))).first()
        if not n:
            raise RuntimeError("no labelled row to fit to")
        tasks = config.tasks or tasks_for(n, width, train.sparkSession.sparkContext.defaultParallelism, config.task_bytes, config.task_rows)
        rows = own.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"), fold_of("row_id", config.folds).alias("fold"))
        found: dict[int, dict[int, np.ndarray]] = {}
        for r in materialize(trained(rows, tasks, MODELS, _side_by_side(width, config)), "networks").collect():  # models, not data
            found.setdefault(r["fold"], {})[r["part"]] = np.array(r["numbers"])
        self.networks = {k: Network(p[0].reshape(width, -1), p[1], p[2], p[3]) for k, p in found.items()}
        return self

    def embed(self, rows: DataFrame) -> DataFrame:
        """(row_id, embedding) of rows that took no part in the fit."""
        return self._by_fold(rows, F.lit(-1))

    def embed_train(self, rows: DataFrame) -> DataFrame:
        """(row_id, embedding) of the rows fitted to, each by a network that hasn't seen its fold: one row for each row_id."""
        return self._by_fold(rows, fold_of("row_id", self.config.folds))

    def _by_fold(self, rows: DataFrame, fold: F.Column) -> DataFrame:
        own = rows.where("features is not null").select("row_id", F.col("features").cast("array<double>").alias("features"), fold.cast("int").alias("fold"))
        shared = rows.sparkSession.sparkContext.broadcast(self.networks)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, fold = _features(b.column(1), len(shared.value[-1].w)), b.column(2).to_numpy()
                out = np.zeros((len(x), shared.value[-1].w.shape[1]), np.float32)
                for k in np.unique(fold):
                    out[fold == k] = shared.value[int(k)].embed(x[fold == k])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.tolist(), pa.list_(pa.float32()))], names=["row_id", "embedding"])

        return own.mapInArrow(run, f"row_id {dict(own.dtypes)['row_id']}, embedding array<float>")
