"""Document fingerprints by winnowing: rolling k-gram hashes, the least of each window kept, rightmost on ties, with positions.

Any match of at least ``k + window - 1`` bytes between two texts leaves at least one common (hash, text) selection, and
no match shorter than ``k`` bytes is noticed. A fingerprint is written as base64 of the selections in text order: four
bytes of hash, then the distance from the selection before as a variable-length number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions

BASE = 0x9E3779B97F4A7C15


class Selection(NamedTuple):
    """Selected hashes and the byte positions where their k-grams start, in text order."""

    hashes: np.ndarray
    positions: np.ndarray


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all ``k``-grams of ``data`` (uint8), by doubling: 64 bits, well mixed."""
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, BASE
    done, done_width = None, 0
    left = k
    while True:
        if left & 1:
            if done is None:
                done, done_width = h, width
            else:
                n = len(done) - width
                done = done[:n] * np.uint64(power) + h[done_width : done_width + n]
                done_width += width
        left >>= 1
        if not left:
            break
        h = h[: len(h) - width] * np.uint64(power) + h[width:]
        power, width = power * power & (1 << 64) - 1, 2 * width
    done = done[: len(data) - k + 1]
    done = (done ^ (done >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(32))


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of every ``window`` neighbours."""
    have, width = keys, 1
    while 2 * width <= window:
        have, width = np.minimum(have[:-width], have[width:]), 2 * width
    rest = window - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def winnow(text: bytes, k: int, window: int) -> Selection:
    """Selections of ``text``. One shorter than ``k`` is its own only gram; one with fewer grams than ``window`` is one window."""
    if not text:
        return Selection(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    data = np.frombuffer(text, np.uint8)
    hashes = (gram_hashes(data, min(k, len(data))) >> np.uint64(32)).astype(np.uint64)
    at = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    keys = hashes << np.uint64(32) | (low - at)  # of equal hashes, the rightmost is least
    least = window_minima(keys, min(window, len(keys)))
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return Selection((least >> np.uint64(32)).astype(np.uint32), (low - (least & low)).astype(np.int64))


def encode(found: Selection) -> str:
    """The fingerprint string of a selection."""
    if not len(found.hashes):
        return ""
    gaps = np.diff(found.positions, prepend=0)
    if gaps.max() < 128:  # as a rule: one byte for each gap
        packed = np.empty((len(gaps), 5), np.uint8)
        packed[:, :4] = found.hashes.astype("<u4").view(np.uint8).reshape(-1, 4)
        packed[:, 4] = gaps
        return base64.b64encode(packed.tobytes()).decode()
    out = bytearray()
    for h, g in zip(found.hashes.tolist(), gaps.tolist()):
        out += h.to_bytes(4, "little")
        while g > 127:
            out.append(g & 127 | 128)
            g >>= 7
        out.append(g)
    return base64.b64encode(out).decode()


def decode(fingerprint: str) -> Selection:
    """Inverse of :func:`encode`."""
    raw, at, position, hashes, positions = base64.b64decode(fingerprint), 0, 0, [], []
    while at < len(raw):
        hashes.append(int.from_bytes(raw[at : at + 4], "little"))
        at, shift = at + 4, 0
        while True:
            position += (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                break
        positions.append(position)
    return Selection(np.array(hashes, np.uint32), np.array(positions, np.int64))


def likeness(a: Selection, b: Selection) -> float:
    """Dice's coefficient of the distinct selected hashes: 1 for equal sets (two empty ones too), 0 for disjoint ones."""
    x, y = np.unique(a.hashes), np.unique(b.hashes)
    if not len(x) and not len(y):
        return 1.0
    return 2.0 * len(np.intersect1d(x, y, assume_unique=True)) / (len(x) + len(y))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected long"


def _at_most(cuts: list[int], edges: Column, at: Column) -> Column:
    """How many of the sorted ``cuts`` (as a column: ``edges``) are at most ``at``: found in one of about as many groups as a group has cuts."""
    width = max(int(len(cuts) ** 0.5), 1)
    ends = F.array(*[F.lit(c) for c in cuts[width - 1 :: width]]) if cuts else edges
    groups = F.array(F.size(F.filter(ends, lambda c: c <= at)))
    return F.element_at(F.transform(groups, lambda g: g * width + F.size(F.filter(F.slice(edges, g * width + 1, F.lit(width)), lambda c: c <= at))), 1)


def edited_fingerprints(docs: DataFrame, k: int = 12, window: int = 24) -> DataFrame:
    """Fingerprints of every text of ``docs`` and of its edited text, and their likeness; the columns are those of ``SCHEMA``.

    The next document is the one before by doc_id (after the least: the greatest). A null text counts as empty; a null
    doc_id comes after all others; rows of one doc_id are ordered by a hash of the text; a lone row is its own next. An empty table gives
    an empty result. Other columns are ignored.

    Rows are dealt once, by ranges of doc_id whose bounds come from the ids alone; each range's first row also goes to the
    range before it, so that one pass over a sorted range sees every row with its next. A range holds about as many ids
    as any other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(2 * shuffle_partitions(spark), 8)
    at = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = rows.select(at.alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)  # ids: a few bytes for each range
    cuts = sorted({int(c) for c in cuts})
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    #: Range 0 has the greatest ids.
    rows = rows.withColumn("part", F.lit(len(cuts)) - _at_most(cuts, edges, at))
    order = F.struct(at.alias("at"), F.xxhash64("text").alias("h"))
    heads = {r["part"]: (r["head"]["at"], r["head"]["h"]) for r in rows.groupBy("part").agg(F.max(order).alias("head")).collect()}  # a row for each range
    used = sorted(heads)
    if not used:
        return spark.createDataFrame([], SCHEMA)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first range's head follows the last range
    head = F.get(F.array(*[F.struct(*[F.lit(x).cast("bigint") for x in (*heads.get(p, (None, None)), before.get(p))]) for p in range(used[-1] + 1)]), F.col("part"))
    also = F.when((at == head["col1"]) & (F.xxhash64("text") == head["col2"]), head["col3"].cast("int"))
    dealt = rows.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(F.col("part"), F.lit(0).alias("ahead")), F.struct(also.alias("part"), F.lit(1).alias("ahead"))), lambda x: x["part"].isNotNull())).alias("to"))
    dealt = dealt.select(F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"), "doc_id", "text")
    ranged = dealt.repartitionById(used[-1] + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    return ranged.mapInArrow(_pairs(k, window), SCHEMA)


def _pairs(k: int, window: int):
    """Over sorted ranges, each ended by its look-ahead row: every row with the one that follows it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, selected, ended = None, None, False

        for b in batches:
            out: list[tuple] = []
            for part, ahead, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if ahead and ended:  # repeated rows may send more than one look-ahead row
                    continue
                own = winnow(text.encode(), k, window)
                if held is not None and held[0] == part:
                    out.append(_compare(held, selected, text, own, k, window))
                held, selected, ended = (None if ahead else (part, doc_id, text)), own, bool(ahead)
                if len(out) >= 512:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return run


def _compare(held: tuple, selected: Selection, following: str, following_selected: Selection, k: int, window: int) -> tuple:
    _, doc_id, text = held
    new = edited(text, following).encode()
    found = winnow(new, k, window)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), encode(selected), encode(found), likeness(selected, found), likeness(selected, following_selected), len(selected.hashes)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    columns = list(zip(*out)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])
