"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents that one task reads. Its words become symbols; a suffix array over all of them gives the
Burrows-Wheeler transform, held as a wavelet tree of bit vectors with rank counts. Test phrases go backwards through
the index, all at once; the interval that is left holds their occurrences, which are located by walking to the nearest
sampled suffix position, and the hit spans of a document are merged.

A shard's index is made once. A benchmark of one block of phrases is looked up as soon as it is there; for more blocks the
indexes are written as a table and each block is looked up in them, without another look at the texts.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, materialize

#: A word byte: 0-9, a-z (A-Z lowered) and all beyond ASCII; others split words.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD).split()


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol, from the highest; zeros go before ones.

    Bits are in words of 64, with the number of ones before each word.
    """

    def __init__(self, bits: np.ndarray, zeros: np.ndarray):
        self.bits, self.zeros = bits, zeros  # a row of words for each level; zeros in the level
        counts = np.bitwise_count(bits).astype(np.int64)
        self.before = (np.cumsum(counts, axis=1) - counts).astype(np.int32 if bits.shape[1] < 1 << 25 else np.int64)

    @classmethod
    def of(cls, seq: np.ndarray, n_bits: int) -> WaveletTree:
        words = len(seq) // 64 + 1
        bits, zeros = np.zeros((n_bits, words), "<u8"), np.zeros(n_bits, np.int64)
        for level in range(n_bits):
            bit = (seq >> (n_bits - 1 - level) & 1).astype(bool)
            own = np.packbits(bit, bitorder="little")
            bits[level].view(np.uint8)[: len(own)] = own
            zeros[level] = len(seq) - np.count_nonzero(bit)
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(bits, zeros)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a level."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` of the sequence."""
        n, start, at = len(self.zeros), np.zeros_like(at), at.copy()
        for level in range(n):
            one = (symbols >> (n - 1 - level) & 1).astype(bool)
            start, at = (np.where(one, self.zeros[level] + k, x - k) for x, k in ((x, self._ones(level, x)) for x in (start, at)))
        return at - start

    def symbols(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given places."""
        n, found = len(self.zeros), np.zeros_like(at)
        for level in range(n):
            ones = self._ones(level, at)
            one = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            found |= one.astype(np.int64) << (n - 1 - level)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return found


class FMIndex(NamedTuple):
    """FM-index of a sequence of symbols from 1 on; 0 is the end. Every so many suffix positions are kept."""

    counts: np.ndarray  # of each symbol: how many lesser ones there are
    tree: WaveletTree
    marks: WaveletTree  # which rows' positions are kept: a tree of one level
    samples: np.ndarray
    n: int

    @classmethod
    def of(cls, seq: np.ndarray, n_symbols: int, step: int = 8) -> FMIndex:
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        sa = suffix_array(seq)
        counts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))])
        sampled = sa % step == 0
        tree = WaveletTree.of(seq[sa - 1], max(1, int(n_symbols).bit_length()))
        return cls(counts, tree, WaveletTree.of(sampled.astype(np.int64), 1), sa[sampled], len(seq))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (a row each): which ones occur, the first and the end of their suffix intervals."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, column]
            low = self.counts[symbol] + self.tree.rank(symbol, low)
            high = self.counts[symbol] + self.tree.rank(symbol, high)
            left = np.flatnonzero(high > low)
            which, low, high = which[left], low[left], high[left]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows: back to a sampled one, step by step."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            open_ = open_[self.marks.symbols(rows[open_]) == 0]
            at = rows[open_]
            symbol = self.tree.symbols(at)
            rows[open_] = self.counts[symbol] + self.tree.rank(symbol, at)
            steps[open_] += 1
        return self.samples[self.marks.rank(np.ones(len(rows), np.int64), rows)] + steps


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol is least and alone. Only suffixes that are still alike are sorted again."""
    n, bits = len(seq), max(1, int(seq.max()).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate([seq, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)  # of a suffix: the first place of those that it is alike
    own = key[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    sizes = np.diff(np.append(first, n))
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(places):
        at = order[places]
        key = rank[at] * (n + 1) + np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(heads)
        sizes = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(places[first], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


class Phrases(NamedTuple):
    """A block of test phrases: their words, windows of word numbers by length, and the items of each window."""

    words: list[bytes]
    groups: list[tuple[np.ndarray, list[list[str]]]]

    @classmethod
    def of(cls, items: Iterable[tuple[str, bytes]], window: int) -> Phrases:
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [number.setdefault(w, len(number)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        groups = []
        for n in sorted({len(f) for f in found}):
            rows = [f for f in found if len(f) == n]
            groups.append((np.array(rows, np.int64), [sorted(found[f]) for f in rows]))
        return cls(list(number), groups)


class Found(NamedTuple):
    """Of each text: merged hit spans as [first word, end, first, end ...], and the items that occur."""

    spans: list[list[int]]
    items: list[list[str]]


class _Numbers(dict):
    """Numbers of words from 1 on, in the order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Shard(NamedTuple):
    """The index over the distinct texts of a shard; which of them each row has, and its number of words."""

    index: FMIndex
    words: list[bytes]  # symbols from 1 on
    starts: np.ndarray  # of each distinct text: its first place, and the end
    of: np.ndarray
    n_words: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes]) -> Shard:
        distinct: dict[bytes, int] = {}
        of = np.array([distinct.setdefault(t, len(distinct)) for t in texts], np.int64)
        number = _Numbers()
        parts, counts, separator = [], np.zeros(len(distinct), np.int64), np.array([-1])
        for i, t in enumerate(distinct):
            own = words(t)
            counts[i] = len(own)
            parts += [np.fromiter(map(number.__getitem__, own), np.int64, len(own)), separator]  # no phrase crosses texts
        seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        seq[seq < 0] = len(number) + 1
        return cls(FMIndex.of(seq, len(number) + 1), list(number), np.concatenate([[0], np.cumsum(counts + 1)]), of, counts[of] if len(of) else of)

    def find(self, phrases: Phrases) -> Found:
        """Spans and items of every row."""
        symbol = dict(zip(self.words, range(1, len(self.words) + 1)))
        symbols = np.array([symbol.get(w, 0) for w in phrases.words], np.int64)
        spans, items = [], [set() for _ in range(len(self.starts) - 1)]
        for windows, names in phrases.groups:
            own = symbols[windows]
            known = np.flatnonzero((own > 0).all(axis=1))
            hit, low, high = self.index.search(own[known])
            if not len(hit):
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())])
            at = self.index.locate(rows)
            spans.append(np.stack([at, at + windows.shape[1]], axis=1))
            pairs = pd.DataFrame({"text": np.searchsorted(self.starts, at, side="right") - 1, "window": np.repeat(known[hit], high - low)}).drop_duplicates()
            for t, i in zip(pairs["text"].tolist(), pairs["window"].tolist()):
                items[t].update(names[i])
        each: list[list[int]] = [[] for _ in items]
        if spans:
            merged = merge_spans(np.concatenate(spans))
            of = np.searchsorted(self.starts, merged[:, 0], side="right") - 1
            for t, span in zip(of.tolist(), (merged - self.starts[of][:, None]).tolist()):
                each[t] += span
        named = [sorted(x) for x in items]
        rows = self.of.tolist()
        return Found([each[t] for t in rows], [named[t] for t in rows])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        i = self.index
        np.savez(out, counts=i.counts, bits=i.tree.bits, zeros=i.tree.zeros, marks=i.marks.bits, unmarked=i.marks.zeros, samples=i.samples, n=i.n, words=np.frombuffer(b" ".join(self.words), np.uint8), starts=self.starts, of=self.of, n_words=self.n_words)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        own = np.load(io.BytesIO(raw))
        index = FMIndex(own["counts"], WaveletTree(own["bits"], own["zeros"]), WaveletTree(own["marks"], own["unmarked"]), own["samples"], int(own["n"]))
        return cls(index, own["words"].tobytes().split(), own["starts"], own["of"], own["n_words"])


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Spans (first, end) that overlap or touch, merged, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], axis=1)


def _shards(batches: Iterable[pa.RecordBatch], column: int, shard_bytes: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of a task in shards of about ``shard_bytes`` of text, and the texts."""
    held, texts, size = [], [], 0
    for b in batches:
        own = as_bytes(b.column(column))
        held.append(b)
        texts += own
        size += sum(map(len, own))
        if size >= shard_bytes:
            yield pa.Table.from_batches(held), texts
            held, texts, size = [], [], 0
    if texts:
        yield pa.Table.from_batches(held), texts


FOUND = "doc_id long, text_hash long, n_words long, spans array<long>, items array<string>"
INDEXED = "shard long, doc_ids array<long>, text_hashes array<long>, n_words array<long>, index binary"
HITS = "shard long, row int, spans array<long>, items array<string>"


def _looked_up(docs: DataFrame, phrases: Phrases, shard_bytes: int) -> DataFrame:
    """``FOUND`` of every row, by one block of phrases: index and search in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _shards(batches, 2, shard_bytes):
            shard = Shard.build(texts)
            found = shard.find(shared.value)
            rows = pa.table([*(table.column(i) for i in range(2)), pa.array(shard.n_words, pa.int64()), pa.array(found.spans, pa.list_(pa.int64())), pa.array(found.items, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])
            yield from rows.combine_chunks().to_batches()

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, FOUND)


def _indexed(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """A row for each shard: its rows' keys, and its index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (table, texts) in enumerate(_shards(batches, 2, shard_bytes)):
            shard = Shard.build(texts)
            lists = [[table.column(0).to_pylist()], [table.column(1).to_pylist()], [shard.n_words.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | i], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array([shard.to_bytes()], pa.binary())], names=[c.split()[0] for c in INDEXED.split(", ")])

    return materialize(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, INDEXED), "fm-index")


def _hits(indexed: DataFrame, phrases: Phrases) -> DataFrame:
    """Of the rows that some phrase of the block hits: spans and items."""
    shared = indexed.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = Shard.from_bytes(b.column(1)[i].as_py()).find(shared.value)
                rows = [r for r, x in enumerate(found.items) if x]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int32()), pa.array([found.spans[r] for r in rows], pa.list_(pa.int64())), pa.array([found.items[r] for r in rows], pa.list_(pa.string()))], names=["shard", "row", "spans", "items"])

    return materialize(indexed.select("shard", "index").mapInArrow(run, HITS), "fm-hits")


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The test phrases, read row by row, in blocks of at most ``block_bytes`` of text (one longer item is its own block)."""
    held, size, any_ = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id is not null and text is not null").toLocalIterator():
        if size and size + len(row[1]) > block_bytes:
            yield Phrases.of(held, window)
            held, size, any_ = [], 0, True
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
    if held or not any_:
        yield Phrases.of(held, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, block_bytes: int = 4 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items, text_hash) for every row of ``docs``.

    A window is ``window`` neighbouring words of an item, or a shorter item as a whole; a word inside any occurrence is
    hit. ``spans`` are the merged hit words as [first, end, ...], which a caller can cut out. contaminated: some word is
    hit, and at least one in ``one_in``. Null texts have no words; null items don't count; items of one id are one item;
    repeated rows and null ids are kept; an empty benchmark hits nothing. Other columns are ignored.

    A block of phrases is broadcast: its size is bounded by ``block_bytes``. A benchmark of one block needs neither a
    shuffle nor a table; with more, the shards' indexes are written once and each block is looked up in them.
    """
    bounded_batches(docs.sparkSession)
    every = blocks(benchmark, window, block_bytes)
    phrases, following = next(every), next(every, None)
    if following is None:
        found = _looked_up(docs, phrases, shard_bytes)
    else:
        indexed, found = _indexed(docs, shard_bytes), None
        for phrases in chain([phrases, following], every):
            own = _hits(indexed, phrases)
            found = own if found is None else found.unionAll(own)
        rows = indexed.select("shard", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("row", "own"))
        rows = rows.select("shard", "row", F.col("own.doc_ids").alias("doc_id"), F.col("own.text_hashes").alias("text_hash"), F.col("own.n_words").alias("n_words"))
        none = lambda kind: F.array().cast(kind)
        found = rows.join(_merged(found), ["shard", "row"], "left").select("doc_id", "text_hash", "n_words", F.coalesce("spans", none("array<bigint>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    found = found.withColumn("n_hit", F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
        "text_hash",
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, block_bytes: int = 4 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that :func:`contamination` doesn't flag, unchanged, with all their columns.

    A benchmark of one block needs no shuffle: rows go in the pass that looks at them. With more, rows are told apart by
    doc_id and text, so a clean row stays even if another of the same id goes. A null or empty text has no words and stays;
    repeated rows stay or go together; null and empty items match nothing; an empty benchmark keeps all.
    """
    bounded_batches(docs.sparkSession)
    every = blocks(benchmark, window, block_bytes)
    phrases, following = next(every), next(every, None)
    if following is not None:
        flagged = contamination(docs, benchmark, window, one_in, block_bytes, shard_bytes).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        return docs.join(flagged, docs["doc_id"].eqNullSafe(flagged["_id"]) & (F.xxhash64(docs["text"]) == flagged["_hash"]), "left_anti")
    shared, at = docs.sparkSession.sparkContext.broadcast(phrases), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _shards(batches, at, shard_bytes):
            shard = Shard.build(texts)
            hit = [sum(s[1::2]) - sum(s[::2]) for s in shard.find(shared.value).spans]
            clean = [not n or one_in * n < words for n, words in zip(hit, shard.n_words.tolist())]
            yield from table.filter(pa.array(clean, pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def _merged(found: DataFrame) -> DataFrame:
    """The hits of all blocks of phrases, brought together for each row."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.struct(F.element_at("spans", i).alias("a"), F.element_at("spans", i + 1).alias("e")))
    rows = found.withColumn("pairs", pairs).groupBy("shard", "row").agg(F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def join(done, x):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (x["a"] <= last), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.greatest(last, x["e"])))).otherwise(F.concat(done, F.array(x["a"], x["e"])))

    return rows.select("shard", "row", F.aggregate("pairs", F.array().cast("array<bigint>"), join).alias("spans"), "items")
