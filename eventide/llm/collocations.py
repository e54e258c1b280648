"""Phrase collocations by pivot partitioning: n-grams are counted in the share of their rarest word.

Words that occur often enough get numbers by falling frequency, so an n-gram's rarest word, its pivot, is its greatest
number. Around each occurrence of a word as pivot a fragment is cut: up to four words to the left that are more frequent
than it, up to four to the right that are at least as frequent; what is rarer ends it. An n-gram that holds its pivot more
than once belongs to the first of them. So each occurrence of each n-gram lies in exactly one fragment, that of its pivot,
and a share that has all fragments of a pivot counts all its n-grams by itself. Equal fragments are added up before they
are sent, equal texts before they are read. A pivot with very many occurrences is dealt to several shares; what they
counted is added up.

The frequent words are sent to every worker only if they take no more than SENT bytes; beyond that each chunk of texts asks
for the numbers of its own words, and no task holds the vocabulary. Both ways give the same fragments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, bounded_batches, materialize, shuffle_partitions, text_bytes

#: A piece ends at any of these; END stands for it (no UTF-8 text has this byte).
BREAKS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
#: Text that a task holds at once; its words and windows take about 30 times that.
BATCH_BYTES, CHUNK_BYTES = 2 << 20, 2 << 20
#: Fragments of a share, about, and occurrences from which on a pivot is dealt to several shares.
SHARE, HOT = 250_000, 200_000
#: Bytes of frequent words that are broadcast at most.
SENT = 16 << 20
_PIECES = bytes(10 if b in BREAKS else LOWER[b] for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, END between pieces."""
    return text.translate(_PIECES).replace(b"\n", b" " + END + b" ").split()


def _texts(rows: pa.Table | pa.RecordBatch) -> list[tuple[str, list[bytes], int]]:
    """(lang, tokens, copies) of each text."""
    own = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
    texts = as_bytes(own.column("text").combine_chunks()) if own.num_rows else []
    return [(lang, tokens(t), n) for lang, t, n in zip(own.column("lang").to_pylist(), texts, own.column("copies").to_pylist())]


def _counted(rows: pa.Table | pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Langs, words and how often each is there."""
    counts: dict[str, Counter[bytes]] = {}
    for lang, found, copies in _texts(rows):
        own = counts.setdefault(lang, Counter())
        own.update(found if copies == 1 else {w: n * copies for w, n in Counter(found).items()})
    for own in counts.values():
        own.pop(END, None)
    langs = pa.array(list(counts), pa.string()).take(pa.array(np.repeat(np.arange(len(counts)), [len(own) for own in counts.values()])))
    return langs, pa.array([w for own in counts.values() for w in own], pa.binary()).cast(pa.string()), pa.array([n for own in counts.values() for n in own.values()], pa.int64())


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(list(_counted(b)), names=["lang", "word", "n"])


def _chunk_words(chunk: pa.Table) -> pa.Table:
    """The distinct words of a chunk of texts (chunk, lang, text, copies)."""
    langs, words, _ = _counted(chunk)
    return pa.table([pa.array(np.full(len(words), chunk.column("chunk")[0].as_py(), np.int32)), langs, words], names=["chunk", "lang", "word"])


def windows(ids: np.ndarray, reach: int) -> np.ndarray:
    """The fragment around each position of ``ids`` (0: no frequent word): ``reach`` numbers, the pivot, ``reach`` numbers; 0 beyond its ends."""
    n = len(ids)
    padded = np.concatenate([np.zeros(reach, ids.dtype), ids, np.zeros(reach, ids.dtype)])
    out = np.zeros((n, 2 * reach + 1), ids.dtype)
    out[:, reach] = ids
    for side in (-1, 1):
        inside = ids > 0
        for d in range(1, reach + 1):
            near = padded[reach + side * d : reach + side * d + n]
            inside = inside & (near > 0) & (near < ids if side < 0 else near <= ids)
            out[:, reach + side * d] = np.where(inside, near, 0)
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of 32-bit numbers, and the sums of ``n`` over equal ones."""
    width = keys.shape[1]
    raw = pa.Array.from_buffers(pa.binary(4 * width), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).data)])
    found = pa.table([raw, pa.array(n)], names=["key", "n"]).group_by("key", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    if not found.num_rows:
        return keys[:0], n[:0]
    key = found.column("key").chunk(0)
    return np.frombuffer(key.buffers()[1], keys.dtype)[key.offset * width : (key.offset + len(key)) * width].reshape(-1, width), found.column("n_sum").to_numpy()


def _trimmed(rows: np.ndarray) -> pa.Array:
    """Each row's numbers other than 0, which stand side by side, as bytes."""
    held = rows > 0
    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.data), pa.py_buffer(rows[held].tobytes())])


FRAGMENTS = "share int, fragment binary, n long"


class Known(NamedTuple):
    """Numbers of words by lang, and over how many shares each number is dealt, in ascending order."""

    ids: dict[str, dict[bytes, int]]
    number: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, langs: list[str], words: list[bytes], ids: np.ndarray, f: np.ndarray) -> Known:
        found: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(langs, words, ids.tolist()):
            found.setdefault(lang, {})[word] = i
        order = np.argsort(ids)
        return cls(found, ids[order], -(-f[order] // HOT))


def _cut(texts: list[tuple[str, list[bytes], int]], known: Known, reach: int, shares: int) -> list[pa.Array]:
    """``FRAGMENTS`` of texts, equal ones added up. A pivot that is dealt to several shares goes by its fragments' hash."""
    flat, sizes = [], [0]
    for lang, words, _ in texts:
        find = known.ids.get(lang, {}).get
        flat += [find(w, 0) for w in words]
        flat.append(0)
        sizes.append(len(flat))
    rows = windows(np.array(flat, np.int32), reach)
    n = np.repeat(np.array([copies for _, _, copies in texts], np.int64), np.diff(sizes))
    use = (rows[:, reach - 1] > 0) | (rows[:, reach + 1] > 0)
    rows, n = _summed(rows[use], n[use])
    mix, pivot = np.zeros(len(rows), np.uint64), rows[:, reach].astype(np.uint64)
    for c in rows.T:
        mix = (mix ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    of = known.parts[np.searchsorted(known.number, rows[:, reach])].astype(np.uint64) if len(rows) else pivot
    salt = np.where(of > 1, mix % np.maximum(of, np.uint64(1)), np.uint64(0))
    share = ((pivot * np.uint64(0x9E3779B1) + salt * np.uint64(0x85EBCA77)) >> np.uint64(8)) % np.uint64(shares)
    return [pa.array(share.astype(np.int32) + np.where(of > 1, shares, 0).astype(np.int32)), _trimmed(rows), pa.array(n)]


FRAGMENTS = "share int, fragment binary, n long"
NAMES = ["share", "fragment", "n"]


def fragments_by_broadcast(texts: DataFrame, words: DataFrame, reach: int, shares: int) -> DataFrame:
    """``FRAGMENTS`` where the frequent words are few enough to be sent to every worker, which the caller has checked."""
    found = words.select("lang", "word", "id", "f").collect()
    shared = texts.sparkSession.sparkContext.broadcast(Known.of([r["lang"] for r in found], [r["word"].encode() for r in found], np.array([r["id"] for r in found], np.int64), np.array([r["f"] for r in found], np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(_cut(_texts(b), shared.value, reach, shares), names=NAMES)

    return texts.select("lang", "text", "copies").mapInArrow(run, FRAGMENTS)


def fragments_by_chunk(texts: DataFrame, words: DataFrame, reach: int, shares: int) -> DataFrame:
    """``FRAGMENTS`` with any number of frequent words: each chunk of texts asks for the numbers of its own words."""
    chunks = texts.withColumn("chunk", F.pmod(F.xxhash64("lang", "text"), F.lit(max(-(-text_bytes(texts) // CHUNK_BYTES), 1))).cast("int"))
    asked = chunks.groupBy("chunk").applyInArrow(_chunk_words, "chunk int, lang string, word string")
    known = asked.join(words.select("lang", "word", "id", "f"), ["lang", "word"])

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        known = Known.of(found.column("lang").to_pylist(), found.column("word").cast(pa.binary()).to_pylist(), found.column("id").to_numpy().astype(np.int64), found.column("f").to_numpy())
        return pa.table(_cut(_texts(own), known, reach, shares), names=NAMES)

    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, FRAGMENTS)


GRAMS = "gram binary, n long"


def mined(fragments: pa.Array, n: np.ndarray, longest: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) by length from 2 on: of each fragment those that hold its pivot; counts under ``least`` are left out."""
    raw = fragments.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 4
    flat, lengths = np.frombuffer(raw.buffers()[2], np.int32), np.diff(ends)
    rows = np.zeros((len(raw), 2 * longest - 1), np.int32)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat[ends[0] : ends[-1]]
    pivot = rows.argmax(axis=1)  # the first of equals
    out = []
    for size in range(2, longest + 1):
        keys, counts = [], []
        for left in range(size):
            own = np.flatnonzero((pivot >= left) & (pivot + size - left <= lengths))
            keys.append(rows[own[:, None], (pivot[own] - left)[:, None] + np.arange(size)])
            counts.append(n[own])
        found, total = _summed(np.concatenate(keys), np.concatenate(counts))
        out.append((found[total >= least], total[total >= least]))
    return out


def _mine(longest: int, least: int, shares: int):
    def run(share: pa.Table) -> pa.Table:
        whole = share.column("share")[0].as_py() < shares  # all fragments of its pivots are here
        found = mined(share.column("fragment").combine_chunks(), share.column("n").to_numpy(), longest, least if whole else 1)
        parts = [pa.table([_trimmed(keys.astype(">i4")) if len(keys) else pa.array([], pa.binary()), pa.array(n, pa.int64())], names=["gram", "n"]) for keys, n in found]
        return pa.concat_tables(parts)

    return run


def frequent_words(counts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id): words that occur ``least`` times in their language; numbers from 1 on by falling frequency, without a global task."""
    own = counts.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    own = materialize(own.orderBy(F.desc("f"), "lang", "word").select("lang", "word", "f", F.monotonically_increasing_id().alias("m")), "words")
    part = F.shiftright("m", 33)
    sizes = own.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row for each partition of the sort
    before = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = own.withColumn("part", part).join(before, "part")
    return materialize(rows.select("lang", "word", "f", (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1) + 1).cast("int").alias("id")), "words")


def _bytes_of(number: str | Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 8, "0"))


def _bits(gram: Column, first: Column | int, size: Column | int) -> Column:
    """Words ``first`` (from 0) and so on of an n-gram."""
    first, size = (F.lit(x) if isinstance(x, int) else x for x in (first, size))
    return F.substring(gram, first * 4 + 1, size * 4)


def scored(grams: DataFrame, words: DataFrame, totals: DataFrame, scale: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the n-grams that no longer one stands for."""
    size = (F.length("gram") / 4).cast("int")
    found = grams.select("gram", F.col("n").alias("a"), size.alias("size"))
    known = found.select("gram", "a").union(words.select(_bytes_of("id"), "f"))
    longer = found.where("size > 2").select("a", F.explode(F.array(_bits(F.col("gram"), 0, F.col("size") - 1), _bits(F.col("gram"), 1, F.col("size") - 1))).alias("gram"))
    # one word more is enough: between a phrase and a longer one that is as frequent, all are
    longer = longer.groupBy("gram").agg(F.max("a").alias("longer"))
    kept = found.join(longer, "gram", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).select("gram", "a", "size")

    spelt = kept.select("gram", F.posexplode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i", "at")).select("gram", "i", F.conv(F.hex(_bits(F.col("gram"), F.col("at"), 1)), 16, 10).cast("int").alias("id"))
    spelt = spelt.join(words.select("id", "lang", "word"), "id").groupBy("gram").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))

    cuts = kept.select("gram", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("gram", "a", "k", _bits(F.col("gram"), 0, F.col("k")).alias("first"), _bits(F.col("gram"), F.col("k"), F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select(F.col("gram").alias("first"), F.col("a").alias("l")), "first").join(known.select(F.col("gram").alias("rest"), F.col("a").alias("r")), "rest")
    own = cuts.join(spelt, "gram").join(totals, "lang")
    # products of up to 38 digits, divided exactly
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = own.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    return lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def top_ranks(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang with their ``rank``: each of several parts of a lang is ranked first, so no task sorts a whole one."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = shuffle_partitions(rows.sparkSession)
    some = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    return some.drop("_part", "_rank").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


COLLOCATIONS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, scale: int = 1000) -> DataFrame:
    """``COLLOCATIONS``: each language's phrases of 2 to ``longest`` words that occur ``least`` times, by falling score.

    Texts (lang, text) are lower-cased (A-Z) and split at ``BREAKS`` into pieces, those at spaces and tabs into words; all
    is counted by lang, null as ``und``. a: occurrences of the phrase, n: of all words; l and r: those of its two parts at
    the cut with the lowest score floor(scale * a * n / (l * r)), of equals the first. Phrases in a longer one that occurs
    as often are left out. Ties rank by a, then by the phrase's bytes.

    A null text is empty and counts nothing; repeated rows count again; other columns play no part. No text with frequent
    words: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    own = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), "text")
    texts = materialize(own.groupBy("lang", "text").agg(F.count("*").alias("copies")), "texts")
    counts = materialize(texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    words = frequent_words(counts, least)
    occurrences, size = words.agg(F.sum("f"), F.sum(F.octet_length("lang") + F.octet_length("word") + 16)).first()
    shares = max(-(-(occurrences or 0) // SHARE), 4 * shuffle_partitions(spark))
    fragments = (fragments_by_broadcast if (size or 0) <= SENT else fragments_by_chunk)(texts, words, longest - 1, shares)
    mine = fragments.groupBy("share").applyInArrow(_mine(longest, least, shares), GRAMS)
    grams = materialize(mine.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")
    found = scored(grams, words, counts.groupBy("lang").agg(F.sum("n").alias("n")), scale)
    return top_ranks(found, top).select(*COLLOCATIONS)
