"""Language-model scores: prediction by partial matching over bytes, beside a unigram base.

The model is a trie of byte contexts up to ``order``, pretrained on all training texts. A context either has seen the
next byte, or the model escapes to the context without its first byte, where the bytes that the longer context has seen
are excluded from all counts (symbol exclusion). Escape probabilities are estimated from the training counts, pooled over
contexts alike; what they leave is shared among the seen bytes by count less one half. Below the empty context all bytes
not yet excluded are equally likely. Since the counts don't change while a text is scored, a context's exclusions are
those of one node, and everything but lookups is worked out once.

The trie stays in shares, level by level, at every size: no task holds it whole. Each chunk of texts asks the shares for its
distinct grams; the few that the longest contexts haven't seen go down the levels' shares until one has them.

Texts are scored as their lower-cased words with one space between them, then an end.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, bounded_batches, chunk_rows, chunked, materialize, packed, shuffle_partitions, text_bytes, unpacked

START, END = b"\xfe", b"\xff"  # no UTF-8 text has these bytes
#: Bytes that a text can have, and the end.
SYMBOLS = 257
#: Texts' bytes for each share of the statistics, at least.
SHARE_BYTES = 32 << 20
#: Texts' bytes whose grams are worked out at once; they take some forty times as much.
PART_BYTES = 1 << 20


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def normal(text: bytes) -> bytes:
    return b" ".join(tokens(text))


def packed_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each text, and its end, with the ``order`` bytes before it, as one number; where each text starts."""
    pad = START * order
    data = np.frombuffer(b"".join([*chain.from_iterable((pad, t, END) for t in texts), bytes(8)]), np.uint8)
    keys = np.ndarray(max(len(data) - 8 - order, 0), ">u8", data, strides=(1,)).astype(np.uint64)
    keys >>= np.uint64(8 * (7 - order))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    # a text's predictions start where its padding starts, and the padding of the next one is skipped
    own = np.ones(len(keys), bool)
    for i in range(order):
        own[starts[1:] + np.arange(len(texts) - 1) * order + i] = False
    return keys[own], starts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order, and how often each is there."""
    own = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    return own[first], np.diff(np.append(first, len(own)))


class HashTable:
    """Values by 64-bit key, looked up for many keys at once."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.size = 1 << int(64 - self.shift)
        self.keys, self.values = np.full(self.size, self.EMPTY), np.zeros(self.size, np.float32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            at %= self.size
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            slot, which = np.unique(at[free], return_index=True)
            put = left[free[which]]
            self.keys[slot], self.values[slot] = keys[put], values[put]
            rest = np.ones(len(left), bool)
            rest[free[which]] = False
            left, at = left[rest], at[rest]
            at = at + (self.keys[at % self.size] != self.EMPTY)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; NaN where a key isn't there."""
        at = self._home(keys)
        seen = self.keys[at]
        out = self.values[at]
        odd = np.flatnonzero(seen != keys)
        while len(odd):
            gone = seen[odd] == self.EMPTY if len(seen) == len(keys) else seen == self.EMPTY
            out[odd[gone]] = np.nan
            odd = odd[~gone]
            at[odd] = (at[odd] + 1) % self.size
            seen = self.keys[at[odd]]
            same = seen == keys[odd]
            out[odd[same]] = self.values[at[odd[same]]]
            odd, seen = odd[~same], seen[~same]
        return out


class Contexts:
    """The nodes of one order: sums over their bytes, and what is left of the next shorter node without these bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        contexts = grams >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))[: len(grams)]
        self.keys, self.of = contexts[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grams))))
        self.total, self.distinct = np.add.reduceat(counts, first), np.diff(np.append(first, len(grams)))
        self.left_total = self.left_distinct = None

    def exclude_from(self, shorter: Contexts, gram_mask: int, context_mask: int) -> None:
        same = np.searchsorted(shorter.grams, self.grams & np.uint64(gram_mask))
        node = np.searchsorted(shorter.keys, self.keys & np.uint64(context_mask))
        excluded = np.bincount(self.of, weights=shorter.counts[same], minlength=len(self.keys))
        self.left_total = shorter.total[node] - excluded
        self.left_distinct = shorter.distinct[node] - self.distinct


class Escapes:
    """Escape probabilities of one order, pooled over contexts of like total and number of distinct bytes.

    Estimated by leaving out each occurrence in turn: what is left is a context with one occurrence less, which has to
    escape if the byte was there once.
    """

    TOTALS, DISTINCT = 64, 24

    def __init__(self, escaped: np.ndarray, stayed: np.ndarray):
        at_most = np.arange(1, self.DISTINCT + 1)[None, :] / 2.0 ** (np.arange(self.TOTALS)[:, None] / 2)
        prior = np.clip(0.5 * at_most, 1e-4, 0.5).ravel()  # distinct / (2 total), where nothing is known
        self.table = np.clip((escaped + 2 * prior) / (escaped + stayed + 2), 1e-7, 0.95)

    @classmethod
    def sums(cls, level: Contexts) -> tuple[np.ndarray, np.ndarray]:
        """How often the contexts of each class escaped and stayed; sums of several shares add up."""
        once = np.bincount(level.of[level.counts == 1], minlength=len(level.keys))
        size = cls.TOTALS * cls.DISTINCT
        more = level.total > 1
        total, distinct, once = level.total[more], level.distinct[more], once[more]
        escaped = np.bincount(cls._class(total - 1, np.maximum(distinct - 1, 1)), weights=once, minlength=size)
        stayed = np.bincount(cls._class(total - 1, distinct), weights=total - once, minlength=size)
        return escaped, stayed

    @classmethod
    def _class(cls, total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        t = np.minimum((2 * np.log2(np.maximum(total, 1))).astype(np.int64), cls.TOTALS - 1)
        return t * cls.DISTINCT + np.minimum(distinct.astype(np.int64), cls.DISTINCT) - 1

    def of(self, total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        return self.table[self._class(total, np.maximum(distinct, 1))]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys``; -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def seen_log(escapes: Escapes, count: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """log10 probability of a byte that its context has seen ``count`` times."""
    return np.log10((1 - escapes.of(total, distinct)) * (count - 0.5) / (total - 0.5 * distinct))


def descend(level: Contexts, escapes: Escapes, d: int, keys: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, ...]:
    """One level of scoring: (gain, hit, total, distinct) of each key at the contexts of ``d`` bytes.

    ``total`` and ``distinct`` are what the longer node leaves of this one, NaN where no longer node is known; returned is
    what this one leaves of the next.
    """
    total, distinct, gain = total.copy(), distinct.copy(), np.zeros(len(keys))
    gram = keys & np.uint64((1 << 8 * (d + 1)) - 1)
    node, place = _find(level.keys, gram >> np.uint64(8)), _find(level.grams, gram)
    fresh = np.isnan(total) & (node >= 0)
    total[fresh], distinct[fresh] = level.total[node[fresh]], level.distinct[node[fresh]]
    hit = place >= 0
    gain[hit] = seen_log(escapes, level.counts[place[hit]], total[hit], distinct[hit])
    miss = ~hit & ~np.isnan(total) & (total > 0)
    gain[miss] = np.log10(escapes.of(total[miss], distinct[miss]))
    left = level.left_total is not None
    return gain, hit, np.where(node >= 0, level.left_total[node], np.nan) if left else np.full(len(keys), np.nan), np.where(node >= 0, level.left_distinct[node], np.nan) if left else np.full(len(keys), np.nan)


class Model:
    """Pretrained trie over grams of ``order`` + 1 bytes: sorted ``grams`` with their ``counts``."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.levels: list[Contexts] = []
        for d in range(order, -1, -1):
            mask = np.uint64((1 << 8 * (d + 1)) - 1)
            own, inverse = np.unique(grams & mask, return_inverse=True)
            self.levels.append(Contexts(own, np.bincount(inverse, weights=counts, minlength=len(own))))
        for i, (longer, shorter) in enumerate(zip(self.levels, self.levels[1:])):
            d = order - i - 1
            longer.exclude_from(shorter, (1 << 8 * (d + 1)) - 1, (1 << 8 * d) - 1)
        top = self.levels[0]
        self.escapes = [Escapes(*Escapes.sums(x)) for x in self.levels] if len(grams) else []
        logs = seen_log(self.escapes[0], top.counts, top.total[top.of], top.distinct[top.of]) if len(grams) else np.zeros(0)
        self.top = HashTable(top.grams, logs)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after the others."""
        out = self.top.get(keys).astype(np.float64) if len(self.levels[0].grams) else np.full(len(keys), np.nan)
        missing = np.flatnonzero(np.isnan(out))
        if len(missing):
            values, inverse = np.unique(keys[missing], return_inverse=True)
            out[missing] = self._escaped(values)[inverse]
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        """As :meth:`scores`, for keys that the longest contexts haven't seen."""
        return self.rest(keys, np.full(len(keys), np.nan), np.full(len(keys), np.nan))

    def rest(self, keys: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Gains of all levels; ``total`` and ``distinct`` as in :func:`descend`."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            if not len(level.grams):
                break
            gain, hit, total, distinct = descend(level, self.escapes[i], self.order - i, keys[open_], total, distinct)
            out[open_] += gain
            open_, total, distinct = open_[~hit], total[~hit], distinct[~hit]
        root = self.levels[-1]
        out[open_] -= math.log10(SYMBOLS - (int(root.distinct[0]) if len(root.keys) else 0))
        return out

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each normal text and its end."""
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 19):
                size += len(texts[end]) + 1
                end += 1
            keys, starts = packed_grams(texts[at:end], self.order)
            out[at:end] = np.add.reduceat(self.scores(keys), starts)
            at = end
        return out


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of normal ``texts``, and the number of each word in order; after a text's words comes its end."""
    joined = b" ".join([t + b" " + END if t else END for t in texts]) + b" "
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(joined)]).dictionary_encode()
    words = found.dictionary.buffers()[2].to_pybytes().split(b" ")[: len(found.dictionary)]
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), found.indices.to_numpy()


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


STATISTICS = "kind string, share int, keys binary, counts binary, n int"
MERGED = "kind string, share int, keys binary, counts binary, n long, total long"


def _counts_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32()))], names=["kind", "share", "keys", "counts", "n"])


def _statistics(order: int, shares: int, folds: int, fold: int, limit: int):
    """Counts of grams and of words in the training texts of a task, by share, whenever about ``limit`` bytes are through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, size = [], [], 0
        for b in batches:
            own, part = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                if not held_out(doc_id, folds, fold):
                    own.append(normal(text))
                    size += len(text)
                    part += len(own[-1])
                if part > PART_BYTES:
                    count(words, grams, own)
                    own, part = [], 0
            if own:
                count(words, grams, own)
            if size > limit:
                yield rows(words, grams)
                words, grams, size = [], [], 0
        yield rows(words, grams)

    def count(words: list, grams: list, texts: list[bytes]) -> None:
        hashes, at = word_numbers(texts)
        put(words, _sum_counts([(hashes, np.bincount(at, minlength=len(hashes)))]))
        put(grams, counted(packed_grams(texts, order)[0]))

    def put(held: list, own: tuple[np.ndarray, np.ndarray]) -> None:
        """Sums of about a size are added up, so that each key is sorted a few times only."""
        held.append(own)
        while len(held) > 1 and 2 * len(held[-1][0]) > len(held[-2][0]):
            held.append(_sum_counts([held.pop(-2), held.pop()]))

    def rows(words: list, grams: list) -> pa.RecordBatch:
        out = []
        for kind, held in (("word", words), ("gram", grams)):
            if held:
                keys, counts = _sum_counts(held)
                held.clear()
                out += _by_share(kind, keys, counts, shares, keys if kind == "word" else _middle(keys, order))
        return _counts_batch(out)

    return run


def _sum_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1 and np.all(parts[0][0][1:] > parts[0][0][:-1]):
        return parts[0]
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)[: len(keys)])
    return keys[last], np.diff(np.cumsum(counts)[last], prepend=counts.dtype.type(0))


def _share_of(keys: np.ndarray, shares: int) -> np.ndarray:
    return ((keys * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(shares)).astype(np.int64)


def _middle(grams: np.ndarray, d: int) -> np.ndarray:
    """Grams of ``d`` + 1 bytes without their first and last. Grams alike in these are in one share, so that it can sum up
    the next shorter grams and the exclusions by itself."""
    return (grams >> np.uint64(8)) & np.uint64((1 << 8 * (d - 1)) - 1)


def _sharded(by: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by the share of ``by``, and where each share starts."""
    share = _share_of(by, shares).astype(np.min_scalar_type(shares))  # numbers of 16 bits are sorted by their digits
    return np.argsort(share, kind="stable"), np.append(0, np.cumsum(np.bincount(share, minlength=shares)))


def _by_share(kind: str, keys: np.ndarray, counts: np.ndarray, shares: int, by: np.ndarray) -> list[tuple]:
    """Rows of sorted ``keys``."""
    order, cuts = _sharded(by, shares)
    keys, counts = keys[order], counts[order]
    return [(kind, i, packed(keys[a:b].astype("<u8")), packed(counts[a:b].astype("<i8")), int(b - a)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (share, kind), which follow each other, as one; ``n`` and ``total`` are what it holds."""
    key, held, size = None, [], 0

    def row() -> pa.RecordBatch:
        keys, counts = _sum_counts(held)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key[0], key[1], keys.tobytes(), counts.tobytes(), len(keys), int(counts.sum())), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["kind", "share", "keys", "counts", "n", "total"])

    for b in batches:
        for kind, share, keys, counts, n in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if (kind, share) != key:
                if held:
                    yield row()
                key, held, size = (kind, share), [], 0
            held.append((unpacked(keys, n, "<u8"), unpacked(counts, n, "<i8")))
            size += len(held[-1][0])
            if size > 1 << 20 and len(held) > 1:  # few keys come often: sum them up as they come
                held = [_sum_counts(held)]
                size = 0
    if held:
        yield row()


def corpus_statistics(docs: DataFrame, order: int, folds: int, fold: int, n: int) -> DataFrame:
    """(kind, share, keys, counts, n, total): counts of all words and of all grams of the training texts of ``docs``, in ``n`` shares."""
    parts = docs.select("doc_id", "text").mapInArrow(_statistics(order, n, folds, fold, 32 << 20), STATISTICS)
    merged = parts.repartitionById(n, F.col("share")).sortWithinPartitions("share", "kind").mapInArrow(_merged, MERGED)
    return materialize(merged, "lm-statistics")


def _shorter(d: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of ``d`` bytes within a share's grams of ``d`` + 1."""
    return _sum_counts([(keys & np.uint64((1 << 8 * d) - 1), counts)])


def _shorten(d: int, shares: int):
    """A share's grams of ``d`` bytes, by the shares of their own level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own, sums = _shorter(d, np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"))
                out = _by_share("gram", own, sums, shares, _middle(own, d - 1) if d > 1 else np.zeros(len(own), np.uint64))
                yield _counts_batch(out)

    return run


def _level(d: int, keys: bytes, counts: bytes) -> Contexts:
    """The nodes of ``d`` bytes in a share, and what they leave of the next shorter ones."""
    grams, sums = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8").astype(np.float64)
    level = Contexts(grams, sums)
    level.exclude_from(Contexts(*_shorter(d, grams, sums)), (1 << 8 * d) - 1, (1 << 8 * (d - 1)) - 1)
    return level


def _escape_sums(d: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                escaped, stayed = Escapes.sums(Contexts(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8").astype(np.float64)))
                some = np.flatnonzero((escaped > 0) | (stayed > 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), pa.array(some.astype(np.int32)), pa.array(escaped[some].astype(np.int64)), pa.array(stayed[some].astype(np.int64))], names=["level", "class", "escaped", "stayed"])

    return run


class Levels(NamedTuple):
    """The trie: shares of the grams of each level but the lowest, all escape probabilities, and a model of the lowest.

    The lowest levels have contexts of at most one byte, 257 * 257 grams whatever the input, and are one small model.
    """

    shares: dict[int, DataFrame]
    escapes: dict[int, Escapes]
    root: Model


def build(statistics: DataFrame, order: int, n: int) -> Levels:
    """The levels of contexts of ``order`` bytes and fewer. Only the lowest grams and sums by class come to the driver."""
    grams = statistics.where("kind = 'gram'").select("kind", "share", "keys", "counts")
    low = min(order - 1, 1)
    shares = {order: grams}
    for d in range(order, low, -1):
        made = shares[d].mapInArrow(_shorten(d, n), STATISTICS)
        if d - 1 > low:
            made = made.repartitionById(n, F.col("share")).sortWithinPartitions("share", "kind").mapInArrow(_merged, MERGED)
            shares[d - 1] = materialize(made.select("kind", "share", "keys", "counts"), "lm-grams")
    lowest = made.select("keys", "counts", "n").toArrow()
    parts = [(unpacked(k, n, "<u8"), unpacked(c, n, "<i8")) for k, c, n in zip(*(lowest.column(i).to_pylist() for i in range(3)))]
    sums = reduce(DataFrame.unionAll, [x.mapInArrow(_escape_sums(d), "level int, class int, escaped long, stayed long") for d, x in shares.items()])
    size = Escapes.TOTALS * Escapes.DISTINCT
    found = {d: (np.zeros(size), np.zeros(size)) for d in shares}
    for r in sums.groupBy("level", "class").agg(F.sum("escaped").alias("escaped"), F.sum("stayed").alias("stayed")).collect():
        found[r["level"]][0][r["class"]], found[r["level"]][1][r["class"]] = r["escaped"], r["stayed"]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Levels(shares, {d: Escapes(*x) for d, x in found.items()}, Model(*_sum_counts(parts or [none]), low))


def _distinct_words(hashes: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    keys = counted(hashes)[0]
    order, cuts = _sharded(keys, shares)
    return keys[order], cuts


#: Rows of statistics come before a share's requests.
WORDS, GRAMS = -1, -2
REQUESTS = "share int, chunk int, a binary, b binary, n_a int, n_b int"


def _requests(order: int, shares: int):
    """A chunk's distinct words and grams, by share of the statistics."""

    def run(chunk: pa.Table) -> pa.Table:
        texts = [normal(t) for t in as_bytes(chunk.column("text").combine_chunks())]
        words, word_cuts = _distinct_words(word_numbers(texts)[0], shares)
        grams = counted(packed_grams(texts, order)[0])[0]
        by, gram_cuts = _sharded(_middle(grams, order), shares)
        grams = grams[by]
        n = chunk.column("chunk")[0].as_py()
        out = [(i, packed(words[a:b]), packed(grams[c:d]), b - a, d - c) for i, (a, b, c, d) in enumerate(zip(word_cuts[:-1], word_cuts[1:], gram_cuts[:-1], gram_cuts[1:])) if b > a or d > c]
        return pa.table({"share": pa.array([r[0] for r in out], pa.int32()), "chunk": pa.array([n] * len(out), pa.int32()), "a": pa.array([r[1] for r in out], pa.binary()), "b": pa.array([r[2] for r in out], pa.binary()), "n_a": pa.array([r[3] for r in out], pa.int32()), "n_b": pa.array([r[4] for r in out], pa.int32())})

    return run


ANSWERS = "chunk int, share int, words binary, counts binary, totals binary, distinct binary"


def _packed_counts(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, or 64 where one needs them; the first byte tells."""
    kind = "<u8" if len(values) and values.max() >= 1 << 32 else "<u4"
    return kind[-1].encode() + packed(values.astype(kind))


def _unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    return unpacked(raw[1:], n, "<u" + raw[:1].decode()).astype(np.float64)


def _contexts_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of sorted ``grams``, and the place of each gram's."""
    contexts = grams >> np.uint64(8)
    new = np.concatenate([[True], contexts[1:] != contexts[:-1]])[: len(grams)]
    return contexts[new], np.cumsum(new) - 1


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each requested word its count, for each gram its count, and for each of the grams' contexts its sum and its number of
    distinct bytes; 0 for what isn't there. A share's statistics are held, its requests pass by."""

    def of(keys: np.ndarray, wanted: np.ndarray, *columns: np.ndarray) -> list[bytes]:
        at = _find(keys, wanted)
        return [_packed_counts(np.where(at >= 0, c[at], 0) if len(c) else np.zeros(len(at), np.int64)) for c in columns]

    key = None
    for b in batches:
        out = []
        for share, chunk, first, second, n_first, n_second in zip(*[b.column(i).to_pylist() for i in range(6)]):
            if share != key:
                key, none = share, np.zeros(0, "<u8")
                words, counts, level = none, none, Contexts(none, none)
            if chunk == WORDS:
                words, counts = np.frombuffer(first, "<u8"), np.frombuffer(second, "<i8")
            elif chunk == GRAMS:
                level = Contexts(np.frombuffer(first, "<u8"), np.frombuffer(second, "<i8"))
            else:
                grams = unpacked(second, n_second, "<u8")
                out.append((chunk, share, *of(words, unpacked(first, n_first, "<u8"), counts), *of(level.grams, grams, level.counts), *of(level.keys, _contexts_of(grams)[0], level.total, level.distinct)))
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["chunk", "share", "words", "counts", "totals", "distinct"])


SCORED = "chunk int, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, missed binary, times binary"


#: A part of a chunk's texts whose grams are counted together: so many texts at most, and about so many bytes.
TEXTS, TEXTS_BYTES = 256, 1 << 19


class TextGrams(NamedTuple):
    """Distinct grams of each text of a part, in order of the grams: each gram's place among the part's ``distinct`` ones, the
    text's number in the part, and how often the text has it."""

    n: int
    distinct: np.ndarray
    of: np.ndarray
    text: np.ndarray
    times: np.ndarray

    @classmethod
    def count(cls, texts: list[bytes], order: int) -> TextGrams:
        keys, starts = packed_grams(texts, order)
        text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.append(starts, len(keys))))
        if order < 7:  # the text's number fits beside the gram
            keys <<= np.uint64(8)
            keys |= text
            own, times = counted(keys)
            text, own = (own & np.uint64(255)).astype(np.intp), own >> np.uint64(8)
            new = np.concatenate([[True], own[1:] != own[:-1]])
        else:
            by = np.argsort(keys, kind="stable")
            keys, text = keys[by], text[by].astype(np.intp)
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.flatnonzero(new | np.concatenate([[True], text[1:] != text[:-1]]))
            own, text, times, new = keys[first], text[first], np.diff(np.append(first, len(keys))), new[first]
        return cls(len(texts), own[new], np.cumsum(new) - 1, text, times)

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each text: the sum over its grams by the ``values`` of the distinct ones, and its grams of value NaN with their times."""
        values = values[self.of]
        missed = np.flatnonzero(np.isnan(values))
        values *= self.times
        values[missed] = 0
        by = missed[np.argsort(self.text[missed], kind="stable")]
        cuts = np.cumsum(np.bincount(self.text[missed], minlength=self.n))[:-1]
        return np.bincount(self.text, weights=values, minlength=self.n), np.split(self.distinct[self.of[by]], cuts), np.split(self.times[by], cuts)


def _text_parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at == TEXTS or size + len(t) > TEXTS_BYTES):
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    yield texts[at:]


def _score(order: int, shares: int, escapes: Escapes, folds: int, fold: int):
    """Rows of a chunk with the sums over the grams that the longest contexts have seen, and the grams that they haven't."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = chunk_rows(chunk)
        if not rows:
            return pa.table([pa.array([], t) for t in SCORED_TYPES], names=SCORED_NAMES)
        texts = [normal(t) for _, t in rows]
        got = {s: own for s, *own in zip(*(answers.column(i).to_pylist() for i in ("share", "words", "counts", "totals", "distinct")))}
        hashes, at = word_numbers(texts)
        words, cuts = _distinct_words(hashes, shares)
        times = np.concatenate([_unpacked_counts(got[i][0], b - a) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])
        by = np.argsort(words)
        times = times[by][np.searchsorted(words[by], hashes)]
        n_words = np.array([t.count(b" ") + 2 if t else 1 for t in texts])
        first = np.cumsum(n_words) - n_words
        known = np.add.reduceat((times > 0).astype(np.int64)[at], first)
        base = np.add.reduceat(np.log10(times + 1.0)[at], first)
        parts = [TextGrams.count(own, order) for own in _text_parts(texts)]
        grams = counted(np.concatenate([x.distinct for x in parts]))[0]
        by, cuts = _sharded(_middle(grams, order), shares)
        values = np.full(len(grams), np.nan)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                contexts, of = _contexts_of(grams[by[a:b]])
                count, total, different = _unpacked_counts(got[i][1], b - a), *(_unpacked_counts(got[i][c], len(contexts))[of] for c in (2, 3))
                seen = np.flatnonzero(count)
                values[by[a:b][seen]] = seen_log(escapes, count[seen], total[seen], different[seen])
        score, missed, missed_times = [], [], []
        for x in parts:
            total, found, often = x.sums(values[np.searchsorted(grams, x.distinct)])
            score.append(total)
            missed += [k.astype("<u8").tobytes() for k in found]
            missed_times += [k.astype("<i8").tobytes() for k in often]
        ids = [i for i, _ in rows]
        columns = (np.full(len(rows), chunk.column("chunk")[0].as_py()), ids, [held_out(i, folds, fold) for i in ids], n_words, known, base, np.concatenate(score), missed, missed_times)
        return pa.table([pa.array(c, t) for c, t in zip(columns, SCORED_TYPES)], names=SCORED_NAMES)

    return run


SCORED_TYPES = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]

#: Grams on their way down: log10 so far, and what the node above leaves of the next. What goes to a share is in few rows, each
#: gram beside its chunk's number; ``share`` is -1 where a level had them, and such rows are of one ``chunk``.
DOWN = "share int, chunk int, chunks binary, keys binary, gain binary, total binary, distinct binary"
DOWN_TYPES = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
DOWN_NAMES = [c.split()[0] for c in DOWN.split(", ")]
DONE = -1
ASKED = 0


def _down_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, DOWN_TYPES)], names=DOWN_NAMES)


def _sent(d: int, shares: int, chunks: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows of ``keys`` by share of the level of ``d`` bytes."""
    order, cuts = _sharded(_middle(keys, d) if d else np.zeros(len(keys), np.uint64), shares)
    columns = [chunks[order].astype("<i4"), keys[order].astype("<u8"), *(v[order].astype("<f8") for v in values)]
    return [(i, ASKED, *(c[a:b].tobytes() for c in columns)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _done(chunks: np.ndarray, keys: np.ndarray, gain: np.ndarray) -> list[tuple]:
    """Rows of ``keys`` by chunk."""
    order = np.argsort(chunks, kind="stable")
    chunks, keys, gain = chunks[order], keys[order].astype("<u8"), gain[order].astype("<f8")
    first = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1]])[: len(chunks)])
    return [(DONE, chunk, None, keys[a:b].tobytes(), gain[a:b].tobytes(), None, None) for chunk, a, b in zip(chunks[first].tolist(), first, np.append(first[1:], len(chunks)))]


def _joined(rows: list[tuple]) -> list[np.ndarray]:
    """(chunks, keys, gain, total, distinct) of rows of asked grams."""
    return [np.frombuffer(b"".join(c), t) for c, t in zip(zip(*rows), ("<i4", "<u8", "<f8", "<f8", "<f8"))]


def _missed(order: int, shares: int):
    """The grams of a batch's rows of a chunk that the longest contexts haven't seen, once each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, list] = {}
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own.setdefault(chunk, []).append(np.frombuffer(raw, "<u8"))
            keys = [np.unique(np.concatenate(parts)) for parts in own.values()]
            if keys:
                chunks, keys = np.repeat(list(own), list(map(len, keys))), np.concatenate(keys)
                none = np.full(len(keys), np.nan)
                yield _down_rows(_sent(order, shares, chunks, keys, np.zeros(len(keys)), none, none))

    return run


def _go_down(d: int, shares: int, escapes: Escapes):
    """A share's level of contexts of ``d`` bytes is held, the grams pass by: what it has is done, the rest goes on."""

    def down(level: Contexts, rows: list[tuple]) -> list[tuple]:
        if not rows:
            return []
        chunks, keys, gain, total, distinct = _joined(rows)
        hit = np.zeros(len(keys), bool)
        if len(level.grams):
            more, hit, total, distinct = descend(level, escapes, d, keys, total, distinct)
            gain = gain + more
        return _done(chunks[hit], keys[hit], gain[hit]) + _sent(d - 1, shares, *(x[~hit] for x in (chunks, keys, gain, total, distinct)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = level = None
        for b in batches:
            out, asked = [], []
            for share, chunk, *columns in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if share != key:
                    out += down(level, asked)
                    key, level, asked = share, _level(d, b"", b""), []
                if chunk == GRAMS:
                    level = _level(d, *columns[1:3])
                else:
                    asked.append(columns)
            yield _down_rows(out + down(level, asked))  # a batch's grams at once, not row by row

    return run


def _at_root(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        for b in batches:
            if b.num_rows:
                chunks, keys, gain, total, distinct = _joined(list(zip(*[b.column(i).to_pylist() for i in range(2, 7)])))
                yield _down_rows(_done(chunks, keys, gain + root.rest(keys, total, distinct)))

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def _add_up(scored: pa.Table, answers: pa.Table) -> pa.Table:
    """The scores of a chunk's rows, with those of their missed grams."""
    keys = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in answers.column("keys").to_pylist())])
    gains = np.concatenate([np.zeros(0, "<f8"), *(np.frombuffer(x, "<f8") for x in answers.column("gain").to_pylist())])
    order = np.argsort(keys, kind="stable")
    keys, gains = keys[order], gains[order]
    out = []
    for score, missed, times in zip(*(scored.column(i).to_pylist() for i in ("score", "missed", "times"))):
        at = np.searchsorted(keys, np.frombuffer(missed, "<u8"))
        out.append(score + float((gains[at] * np.frombuffer(times, "<i8")).sum()))
    return pa.table([*(scored.column(i).combine_chunks() for i in ("doc_id", "held_out", "n_tokens", "n_known", "base_sum")), pa.array(out, pa.float64())], names=[c.split()[0] for c in SCORES.split(", ")])


def resolve(levels: Levels, scored: DataFrame, order: int, shares: int) -> DataFrame:
    """(chunk, keys, gain): log10 probabilities of the grams in ``scored`` that the longest contexts haven't seen."""
    none = F.lit(None).cast("binary")
    low = levels.root.order
    going = scored.where("octet_length(missed) > 0").select("chunk", "missed").mapInArrow(_missed(order, shares), DOWN)
    done = []
    for d in range(order, low, -1):
        model = levels.shares[d].select("share", F.lit(GRAMS).alias("chunk"), none.alias("chunks"), "keys", F.col("counts").alias("gain"), none.alias("total"), none.alias("distinct"))
        both = model.unionAll(going).repartitionById(shares, F.col("share")).sortWithinPartitions("share", "chunk")
        made = materialize(both.mapInArrow(_go_down(d, shares, levels.escapes[d]), DOWN), "lm-down")
        done.append(made.where(F.col("share") == DONE))
        going = made.where(F.col("share") != DONE)
    root = scored.sparkSession.sparkContext.broadcast(levels.root)  # at most 257 * 257 grams
    return reduce(DataFrame.unionAll, [*done, going.mapInArrow(_at_root(root), DOWN)]).select("chunk", "keys", "gain")


def language_model_scores(docs: DataFrame, order: int = 6, folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out; the model and the counts come from all others.
    A token is a lower-cased word or the end of a text. base_score: unigrams with one added to each count. Null texts are
    empty (one token, the end); a null doc_id isn't held out; repeated rows are kept and counted. Without any training row
    all counts are 0. Other columns are ignored. Words are counted by their 64-bit hash. ``order`` is 1 to 7 bytes.

    Counts are gathered by the scan's tasks and summed up by share of the hashes. For scoring, each chunk of texts asks
    every share for the counts of its distinct words, of its distinct grams and of their contexts, so that what is on very
    many rows is asked for once by each chunk. Contexts have ``order`` bytes at every size of the input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = text_bytes(docs)
    n = max(shuffle_partitions(spark), -(-size // SHARE_BYTES))
    statistics = corpus_statistics(docs, order, folds, fold, n)
    levels = build(statistics, order, n)
    words = statistics.where("kind = 'word'")
    sums = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()
    chunks = chunked(docs, size)
    requests = chunks.groupBy("chunk").applyInArrow(_requests(order, n), REQUESTS)
    held = statistics.select("share", F.when(F.col("kind") == "word", WORDS).otherwise(GRAMS).alias("chunk"), "keys", "counts", F.lit(None).cast("int").alias("n_a"), F.lit(None).cast("int").alias("n_b"))
    asked = held.unionAll(requests).repartitionById(n, F.col("share")).sortWithinPartitions("share", "chunk")
    answers = asked.mapInArrow(_answers, ANSWERS)
    scored = materialize(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, n, levels.escapes[order], folds, fold), SCORED), "lm-scored")
    found = scored.groupBy("chunk").cogroup(resolve(levels, scored, order, n).groupBy("chunk")).applyInArrow(_add_up, SCORES)
    base = F.col("base_sum") - F.col("n_tokens") * math.log10(sums["n"] + sums["v"] + 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(sums["n"])).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
