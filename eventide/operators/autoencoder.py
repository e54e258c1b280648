"""A sparse autoencoder with tied weights: h = relu(W x + b_e), xhat = W' h + b_d."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AutoencoderConfig
from ..sources.scratch import materialize, scratch_path
from ..sources.sinks import exists
from .together import Group, tasks_for, trained


class Weights(NamedTuple):
    """w has a row for each unit of the code."""

    w: np.ndarray
    b_e: np.ndarray
    b_d: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w.T + self.b_e, 0.0)

    def decode(self, h: np.ndarray) -> np.ndarray:
        return h @ self.w + self.b_d


def initial(width: int, config: AutoencoderConfig) -> Weights:
    """Uniform weights within sqrt(6 / width), from the seed; no bias."""
    bound, units = np.sqrt(6 / width), int(width * config.factor)
    return Weights(np.random.default_rng(config.seed).uniform(-bound, bound, (units, width)), np.zeros(units), np.zeros(width))


#: Rows of doubles, or twice as many of floats, whose slopes are worked out at once: what a step makes of them stays in a
#: processor's cache.
BLOCK = 512


def slopes(x: np.ndarray, weights: Weights, alpha: float, times: np.ndarray | None = None) -> tuple[float, Weights]:
    """Loss sum((xhat - x)^2) / width + alpha * sum(h) over the rows of ``x``, and its slopes; both add up over parts.

    A row counts as often as ``times`` says, or once. A block of rows is worked out in the type of ``x``, single or double;
    blocks are added up as doubles.
    """
    kind, scale = x.dtype, 2 / x.shape[1]
    rows = min(BLOCK * 8 // kind.itemsize, len(x))
    (w, b_e, b_d), (units, width) = (p.astype(kind) for p in weights), weights.w.shape
    back = np.ascontiguousarray((scale * weights.w.T).astype(kind))
    codes, backs, residuals = np.empty((rows, units), kind), np.empty((rows, units), kind), np.empty((rows, width), kind)
    once = np.ones(rows, kind)
    loss, by_code, by_back = 0.0, np.zeros((units, width)), np.zeros((units, width))
    active, b_e_slope, b_d_slope = np.zeros(units), np.zeros(units), np.zeros(width)
    for at in range(0, len(x), rows or 1):
        own = x[at : at + rows]
        h, d, g = (of[: len(own)] for of in (codes, backs, residuals))
        n = once[: len(own)] if times is None else times[at : at + rows].astype(kind)
        np.matmul(own, w.T, out=h)
        h += b_e
        on = h > 0
        h *= on
        np.matmul(h, w, out=g)
        g += b_d
        g -= own
        np.matmul(g, back, out=d)
        d += kind.type(alpha)
        d *= on
        if times is None:
            loss += float(np.vdot(g, g))
        else:
            d *= n[:, None]
            loss += float(np.vdot(g, g * n[:, None]))
            g *= n[:, None]
        by_code += h.T @ g
        by_back += d.T @ own
        active += n @ h
        b_e_slope += once[: len(own)] @ d
        b_d_slope += once[: len(own)] @ g
    return loss / width + alpha * float(active.sum()), Weights(by_back + scale * by_code, b_e_slope, scale * b_d_slope)


class Adam:
    def __init__(self, start: Weights, config: AutoencoderConfig):
        self.at, self.config, self.step = start, config, 0
        self.first, self.second = ([np.zeros_like(p) for p in start] for _ in range(2))

    def move(self, slope: Weights) -> None:
        self.step += 1
        moved = []
        for i, (p, s) in enumerate(zip(self.at, slope)):
            s = s + self.config.weight_decay * p
            self.first[i] = 0.9 * self.first[i] + 0.1 * s
            self.second[i] = 0.999 * self.second[i] + 0.001 * s**2
            moved.append(p - self.config.rate * (self.first[i] / (1 - 0.9**self.step)) / (np.sqrt(self.second[i] / (1 - 0.999**self.step)) + 1e-8))
        self.at = Weights(*moved)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, kind).reshape(len(rows), -1) if rows else np.zeros((0, 0), kind)


KEPT = "part string, numbers array<double>"


def _packed(adam: Adam, losses: list[float]) -> pa.RecordBatch:
    numbers = {**{f"{k}{i}": p.ravel() for k, of in (("at", adam.at), ("first", adam.first), ("second", adam.second)) for i, p in enumerate(of)}, "step": np.array([float(adam.step)]), "losses": np.array(losses)}
    return pa.RecordBatch.from_arrays([pa.array(list(numbers)), pa.array([v.tolist() for v in numbers.values()], pa.list_(pa.float64()))], names=["part", "numbers"])


def _unpacked(parts: dict[str, np.ndarray], width: int, config: AutoencoderConfig) -> tuple[Adam, list[float]]:
    shapes = ((-1, width), (-1,), (-1,))
    adam = Adam(Weights(*(parts[f"at{i}"].reshape(s) for i, s in enumerate(shapes))), config)
    adam.first, adam.second = ([parts[f"{k}{i}"].reshape(s) for i, s in enumerate(shapes)] for k in ("first", "second"))
    adam.step = int(parts["step"][0])
    return adam, parts["losses"].tolist()


def vectors(embeddings: DataFrame) -> DataFrame:
    """(embedding, times): each vector but null once, with the number of its rows. Floats stay floats, all else becomes double."""
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    own = embeddings.where("embedding is not null").select(F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return own.groupBy("embedding").agg(F.count("*").alias("times"))


def train(embeddings: DataFrame, config: AutoencoderConfig, kept: str | None = None) -> tuple[Weights, list[float]]:
    """Weights and the loss of every epoch, by full-batch Adam on the column ``embedding``; null vectors play no part.

    Equal vectors have equal slopes: tasks of a barrier stage hold each vector once, with the number of its rows, and sum their
    slopes each epoch. The number of tasks (``config.tasks``; 0: by ``task_rows`` and ``task_bytes``) and the order of rows change
    nothing beyond rounding. Vectors of floats are worked on in single precision, others in double; sums over blocks and tasks,
    weights and Adam's state are doubles. Rounding of either kind grows over thousands of epochs. Every ``config.keep_every``
    epochs the state of training is written to the shared folder, or to ``kept``: a lost task sets the stage back to what was
    written last, and a run that finds a state of these parameters in ``kept`` goes on from there.
    """
    own = materialize(vectors(embeddings), "vectors")
    found = own.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not found["n"]:
        raise RuntimeError("no embedding to train on")
    spark, width = embeddings.sparkSession, found["width"]
    kind = np.float32 if dict(own.dtypes)["embedding"] == "array<float>" else np.float64
    tasks = config.tasks or tasks_for(found["n"], width, spark.sparkContext.defaultParallelism, config.task_bytes, config.task_rows)
    root = f"{kept.rstrip('/')}/{config.fingerprint()}" if kept else scratch_path(spark, "autoencoder")
    steps = [*range(config.keep_every, config.epochs, config.keep_every), config.epochs]
    done = [s for s in steps if exists(spark, f"{root}/{s}")]
    state = _read(spark, f"{root}/{done[-1]}") if done else None
    for until in [s for s in steps if not done or s > done[-1]]:
        trained(own, tasks, KEPT, _epochs(width, config, state, until, kind)).write.mode("overwrite").parquet(f"{root}/{until}")
        state = _read(spark, f"{root}/{until}")
    adam, losses = _unpacked(state, width, config)
    return adam.at, losses


def _read(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["part"]: np.array(r["numbers"]) for r in spark.read.schema(KEPT).parquet(path).collect()}  # a model, not data


def _epochs(width: int, config: AutoencoderConfig, state: dict[str, np.ndarray] | None, until: int, kind: type):
    """Training from ``state`` up to epoch ``until`` on numbers of ``kind``."""

    def run(batches: list[pa.RecordBatch], group: Group) -> pa.RecordBatch:
        x = np.concatenate([np.zeros((0, width), kind), *(_matrix(b.column(0), kind) for b in batches)])
        times = np.concatenate([np.zeros(0, np.int64), *(b.column(1).to_numpy() for b in batches)])
        order = np.lexsort(x.T)
        x, times = x[order], None if (times == 1).all() else times[order]
        adam, losses = (Adam(initial(width, config), config), []) if state is None else _unpacked(state, width, config)
        shapes, cuts = [p.shape for p in adam.at], np.cumsum([p.size for p in adam.at])[:-1]
        for _ in range(adam.step, until):
            loss, slope = slopes(x, adam.at, config.alpha, times)
            if group.size > 1:
                sums = group.sum(np.concatenate([*(p.ravel() for p in slope), [loss]]))
                loss, slope = float(sums[-1]), Weights(*(p.reshape(s) for p, s in zip(np.split(sums[:-1], cuts), shapes)))
            losses.append(loss)
            adam.move(slope)
        return _packed(adam, losses)

    return run


def transform(rows: DataFrame, weights: Weights, column: str = "embedding", key: str = "row_id") -> DataFrame:
    """(key, x, h, xhat) of every row: the vector, its code, what the code gives back. A null vector has null for all."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # a model, not data
    own = rows.select(key, F.col(column).cast("array<double>").alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for b in batches:
            vectors = b.column(1).to_pylist()
            some = [i for i, v in enumerate(vectors) if v is not None]
            codes, back = [None] * len(vectors), [None] * len(vectors)
            if some:
                h = shared.value.encode(np.array([vectors[i] for i in some], np.float64))
                for i, a, c in zip(some, h.tolist(), shared.value.decode(h).tolist()):
                    codes[i], back[i] = a, c
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, kind), pa.array(codes, kind), pa.array(back, kind)], names=[key, "x", "h", "xhat"])

    return own.mapInArrow(run, f"{key} {dict(own.dtypes)[key]}, x array<double>, h array<double>, xhat array<double>")


class Embedder(Protocol):
    """What turns feature arrays into embeddings: (row_id, features) to (row_id, embedding)."""

    def embed(self, rows: DataFrame) -> DataFrame: ...


class ProjectionEmbedder:
    """A stand-in where no pretrained model is at hand: a seeded random projection of the features through tanh."""

    def __init__(self, features: int, width: int = 192, seed: int = 42):
        self.matrix = np.random.default_rng(seed).normal(0, 1 / np.sqrt(max(features, 1)), (features, width))

    def embed(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.matrix)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1))
                out = np.tanh(x @ shared.value).astype(np.float32).tolist() if len(x) else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["row_id", "embedding"])

        own = rows.select("row_id", "features")
        return own.mapInArrow(run, f"row_id {dict(own.dtypes)['row_id']}, embedding array<float>")
