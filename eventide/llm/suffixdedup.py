"""Repeated passages across documents, found with a logarithmic family of sparse suffix arrays.

A text's suffixes are sampled where a k-gram is the least of its window, so that every string of ``length`` bytes holds a
sampled suffix, at a place that its bytes alone decide. Suffixes are dealt out to shares by the fingerprint of their first
k bytes; a first pass counts these, since a suffix that begins like none in another document is in no match.

Each batch of documents sends every share a suffix array: its sampled suffixes ordered by their bytes, up to the end of the
last string that holds them, each with the bytes before it back to where the first such string starts. A share is a family
of such arrays whose sizes are powers of two of a batch. A new array is merge-scanned against all levels: suffixes that a
level has are told by its place in the order, the others become a level, and two levels of one size merge into the next.
In the array that is left at the end, suffixes with a long common prefix are neighbours; their strings, compared byte by
byte on both sides, decide which document has a string first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunk_rows, chunked, packed, shuffle_partitions, text_bytes, unpacked
from .fmindex import merge_spans
from .winnowing import gram_hashes, window_minima

MASK48 = np.uint64((1 << 48) - 1)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Texts are sampled together in slices of about so many bytes, which stay in a processor's cache.
SLICE = 1 << 17
#: A fingerprint in about so many documents is dealt out string by string, so that no share gets all of it.
HOT = 1 << 16
SHARE_BYTES = 32 << 20


class Batch(NamedTuple):
    """Texts of a chunk one after another, a byte between them, and runs of string starts that share their sampled suffix."""

    docs: np.ndarray  # of each text: its doc_id
    known: np.ndarray  # whether it has one
    data: np.ndarray
    base: np.ndarray  # where each text starts, and the end
    first: np.ndarray  # of each run: its first start
    count: np.ndarray  # number of starts
    at: np.ndarray  # where the suffix starts
    keys: np.ndarray  # fingerprint of the suffix's first k bytes

    @property
    def row(self) -> np.ndarray:
        return np.searchsorted(self.base, self.first, side="right") - 1


def places(rows: list[tuple[int | None, bytes]], length: int) -> np.ndarray:
    """Where each text of a batch starts, and the end; ``length`` bytes stand before the first."""
    return length + np.cumsum([0, *(len(t) + 1 for _, t in rows)])


def sampled(rows: list[tuple[int | None, bytes]], length: int, k: int) -> Batch:
    base = places(rows, length)
    data = np.frombuffer(bytes(length) + b"".join([t + b"\0" for _, t in rows]) + bytes(length), np.uint8)
    parts, i = [], 0
    while i < len(rows):
        j = max(int(np.searchsorted(base, base[i] + SLICE, side="right")) - 1, i + 1)
        parts.append(_runs(data[base[i] : base[j]], np.diff(base[i : j + 1]) - 1, length, k, int(base[i])))
        i = j
    first, count, at, keys = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(4))
    return Batch(np.array([d or 0 for d, _ in rows], np.int64), np.array([d is not None for d, _ in rows], bool), data, base, first, count, at, keys.astype(np.uint64))


def _runs(data: np.ndarray, lengths: np.ndarray, length: int, k: int, offset: int) -> tuple[np.ndarray, ...]:
    """Runs of a slice of whole texts: first start, number of starts, place of the suffix, fingerprint."""
    n = np.maximum(lengths - length + 1, 0)  # string starts of each text
    if not n.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, k)
    low = np.uint64(0xFFFFFFFF)
    least = window_minima((hashes >> np.uint64(32)) << np.uint64(32) | (low - np.arange(len(hashes), dtype=np.uint64)), length - k + 1)
    text_at = np.cumsum(lengths + 1) - (lengths + 1)
    starts = np.repeat(text_at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    least = least[starts]
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # the place is part of it: no run crosses texts
    at = (low - (least[heads] & low)).astype(np.int64)
    key = hashes[at]
    return starts[heads] + offset, np.diff(np.append(heads, len(least))), at + offset, (key ^ key >> np.uint64(17)) & MASK48


def pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealt(share: np.ndarray, shares: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """A stable order by share, and (share, first, end) of those that have some."""
    order = np.argsort(share, kind="stable")
    cuts = np.searchsorted(share[order], np.arange(shares + 1)).tolist()
    return order, ((i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a)


COUNTS = "share int, chunk int, suffixes binary, documents binary"


def _fingerprints(length: int, k: int, shares: int):
    """A chunk's distinct fingerprints and in how many of its texts each is (at most 255), by share."""

    def run(chunk: pa.Table) -> pa.Table:
        batch = sampled(chunk_rows(chunk), length, k)
        order = np.argsort(batch.keys, kind="stable")
        keys, row = batch.keys[order], batch.row[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        another = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])[: len(keys)]
        counts = np.minimum(np.add.reduceat(another, heads, dtype=np.int64), 255).astype(np.uint8) if len(heads) else np.zeros(0, np.uint8)
        keys = keys[heads]
        order, dealt = _dealt((keys % np.uint64(shares)).astype(np.int64), shares)
        out = [(i, pack48(keys[order[a:b]]), counts[order[a:b]].tobytes()) for i, a, b in dealt]
        n = chunk.column("chunk")[0].as_py()
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([n] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=_names(COUNTS))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


REPEATED = "chunk int, suffixes binary, hot binary"


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one share after another: each chunk's fingerprints that are in more than one text, and the very frequent ones."""
    for rows in _by_share(batches):
        chunks, own = [r["chunk"] for r in rows], [unpack48(r["suffixes"]) for r in rows]
        keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(r["documents"], np.uint8) for r in rows]), minlength=len(keys))[inverse]
        ends = np.cumsum([len(x) for x in own]).tolist()
        found = [(c, x[(t > 1) & (t < HOT)], x[t >= HOT]) for c, x, t in zip(chunks, own, (total[a:e] for a, e in zip([0, *ends], ends)))]
        found = [f for f in found if len(f[1]) or len(f[2])]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), *(pa.array([pack48(f[i]) for f in found], pa.binary()) for i in (1, 2))], names=_names(REPEATED))


def _by_share(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row["share"] != held[0]["share"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class Records(NamedTuple):
    """Form of a sampled suffix as one string of fixed width: its bytes, those before it in reverse, both padded, their numbers.

    The order of such strings is that of the suffixes; equal ones are equal in all their bytes.
    """

    length: int
    k: int

    @property
    def width(self) -> int:
        return 2 * self.length - self.k + 2

    def of(self, batch: Batch, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Records (a row each) of runs of string starts around ``at``."""
        after, before = first + count - 1 + self.length - at, at - first
        windows = np.lib.stride_tricks.sliding_window_view
        out = np.zeros((len(at), self.width), np.uint8)
        out[:, : self.length] = windows(batch.data, self.length)[at]
        out[:, self.length : -2] = windows(batch.data, self.length - self.k)[at - (self.length - self.k)][:, ::-1]
        out[:, -2], out[:, -1] = after, before
        out[:, :-2][~self.inside(after, before)] = 0
        return out

    def inside(self, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which bytes of records aren't padding."""
        return np.concatenate([np.arange(self.length) < after[:, None], np.arange(self.length - self.k) < before[:, None]], axis=1)

    def strings(self, records: np.ndarray) -> np.ndarray:
        """Records as comparable values."""
        return np.ascontiguousarray(records).view(f"S{self.width}").ravel()

    def rows(self, strings: np.ndarray) -> np.ndarray:
        return strings.view(np.uint8).reshape(len(strings), self.width)

    def text(self, record: np.ndarray) -> bytes:
        """All bytes of a record in text order."""
        after, before = int(record[-2]), int(record[-1])
        return record[self.length : self.length + before][::-1].tobytes() + record[:after].tobytes()

    def starts(self, records: np.ndarray) -> np.ndarray:
        """How many strings of ``length`` bytes each has."""
        return records[:, -2].astype(np.int64) + records[:, -1] - self.length + 1


ARRAYS = "share int, chunk int, n int, n_runs int, n_bytes int, after binary, before binary, bytes binary, least binary, spread binary, runs binary, starts binary"


def _suffix_arrays(length: int, k: int, shares: int):
    """A chunk's suffix array of what begins as in another document, by share: equal suffixes once, with their documents' bounds."""
    form = Records(length, k)

    def run(chunk: pa.Table, shared: pa.Table) -> pa.Table:
        batch = sampled(chunk_rows(chunk), length, k)
        none = [np.zeros(0, np.uint64)]
        some, hot = (np.concatenate([unpack48(x) for x in shared.column(c).to_pylist()] or none) for c in ("suffixes", "hot"))
        known = batch.known[batch.row]
        one, many = (np.flatnonzero(np.isin(batch.keys, x) & known) for x in (some, hot))
        step = np.arange(batch.count[many].sum()) - np.repeat(np.cumsum(batch.count[many]) - batch.count[many], batch.count[many])
        by_string = np.repeat(many, batch.count[many])  # of a hot suffix, each string by itself
        first = np.concatenate([batch.first[one], batch.first[by_string] + step])
        count = np.concatenate([batch.count[one], np.ones(len(by_string), np.int64)])
        of = np.concatenate([one, by_string])
        records = form.of(batch, first, count, batch.at[of])
        share = batch.keys[of] % np.uint64(shares)
        share[len(one) :] = _hash_rows(records[len(one) :]) % np.uint64(shares)
        values = form.strings(records)
        order = np.argsort(values, kind="stable")
        values, docs = values[order], batch.docs[batch.row[of[order]]]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
        out = []
        if len(heads):
            least, high = np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)
            n_runs, starts = np.diff(np.append(heads, len(values))), first[order]
            records, share = records[order[heads]], share[order[heads]]
            by, dealt = _dealt(share.astype(np.int64), shares)
            for i, a, b in dealt:
                own = by[a:b]
                r = records[own]
                flat = r[:, :-2][form.inside(r[:, -2], r[:, -1])]
                m = n_runs[own]
                at = np.repeat(heads[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                out.append((i, len(own), len(at), len(flat), *map(packed, (r[:, -2].copy(), r[:, -1].copy(), flat, least[own], (high - least)[own].astype("<u8"), m.astype("<u4"), starts[at].astype("<u4")))))
        n = chunk.column("chunk")[0].as_py() if chunk.num_rows else 0
        columns = list(zip(*out)) or [()] * 11
        numbers = [columns[0], [n] * len(out), *columns[1:4]]
        return pa.table([*(pa.array(c, pa.int32()) for c in numbers), *(pa.array(c, pa.binary()) for c in columns[4:])], names=_names(ARRAYS))

    return run


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for column in wide.view("<u8").T:
        out = (out ^ column) * MIX
        out ^= out >> np.uint64(29)
    return out


class Level(NamedTuple):
    """One array of the family: its size in batches, its suffixes in order, and the number of each."""

    size: int
    suffixes: np.ndarray
    numbers: np.ndarray


class Family:
    """Suffix arrays of geometrically growing size over the batches that have been added; no suffix is in two of them."""

    def __init__(self):
        self.levels: list[Level] = []
        self.n = 0

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Merge-scan a sorted array of distinct suffixes against all levels; numbers of its suffixes, new ones for those not met."""
        numbers = np.full(len(batch), -1)
        for level in self.levels:
            open_ = np.flatnonzero(numbers < 0)
            if not len(level.suffixes) or not len(open_):
                continue
            at = np.minimum(np.searchsorted(level.suffixes, batch[open_]), len(level.suffixes) - 1)
            hit = level.suffixes[at] == batch[open_]
            numbers[open_[hit]] = level.numbers[at[hit]]
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = self.n + np.arange(len(fresh))
        self.n += len(fresh)
        self.levels.append(Level(1, batch[fresh], numbers[fresh]))
        while len(self.levels) > 1 and self.levels[-1].size == self.levels[-2].size:
            self._merge()
        return numbers

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        place = np.searchsorted(a.suffixes, b.suffixes) + np.arange(len(b.suffixes))
        ours = np.ones(len(a.suffixes) + len(b.suffixes), bool)
        ours[place] = False
        suffixes, numbers = np.empty(len(ours), a.suffixes.dtype), np.empty(len(ours), np.int64)
        suffixes[place], suffixes[ours] = b.suffixes, a.suffixes
        numbers[place], numbers[ours] = b.numbers, a.numbers
        self.levels.append(Level(a.size + b.size, suffixes, numbers))

    def whole(self) -> Level:
        """All levels as one."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0]


def first_documents(form: Records, suffixes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Of suffixes in order, with the least document of each: that of all its strings, or of each string where they differ.

    Returns the least over a suffix's strings, and by its place the list of those whose strings differ.
    """
    rows, earliest, each = form.rows(suffixes), least.copy(), {}
    near = (rows[1:, : form.k] == rows[:-1, : form.k]).all(axis=1)  # a common prefix of k bytes or more
    edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
        texts, docs = [form.text(r) for r in rows[a:b]], least[a:b].tolist()
        strings: dict[bytes, int] = {}
        for text, doc in zip(texts, docs):
            for i in range(len(text) - form.length + 1):
                s = text[i : i + form.length]
                if strings.get(s, doc) >= doc:
                    strings[s] = doc
        for j, text in enumerate(texts, a):
            values = [strings[text[i : i + form.length]] for i in range(len(text) - form.length + 1)]
            earliest[j] = min(values)
            if max(values) > earliest[j]:
                each[j] = values
    return earliest, each


ANSWERS = "chunk int, n int, n_parts int, n_values int, starts binary, counts binary, least binary, part_starts binary, part_counts binary, values binary"


def _merge_scan(length: int, k: int):
    """Over the suffix arrays of one share after another: for each run whose strings an earlier document has, where it starts,
    how many strings it has, and the least document of all of them (``least``) or of each (``values``)."""
    form = Records(length, k)

    def suffixes_of(row: dict) -> np.ndarray:
        records = np.zeros((row["n"], form.width), np.uint8)
        records[:, -2], records[:, -1] = unpacked(row["after"], row["n"], "u1"), unpacked(row["before"], row["n"], "u1")
        records[:, :-2][form.inside(records[:, -2], records[:, -1])] = unpacked(row["bytes"], row["n_bytes"], "u1")
        return form.strings(records)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in _streamed(batches):
            family, least, held = Family(), np.zeros(0, np.int64), []
            for row in share:
                numbers = family.add(suffixes_of(row))
                own = unpacked(row["least"], row["n"], "<i8")
                least = np.concatenate([least, np.full(max(family.n - len(least), 0), np.iinfo(np.int64).max)]) if family.n > len(least) else least
                least[numbers] = np.minimum(least[numbers], own)
                held.append((row["chunk"], numbers.astype(np.int32), own, *(row[c] for c in ("n", "n_runs", "spread", "runs", "starts"))))
            array = family.whole()
            found, each = first_documents(form, array.suffixes, least[array.numbers])
            earliest, counts, differ = np.empty(family.n, np.int64), np.empty(family.n, np.int64), np.zeros(family.n, bool)
            earliest[array.numbers], counts[array.numbers] = found, form.starts(form.rows(array.suffixes))
            of_number = {int(array.numbers[j]): np.array(v, np.int64) for j, v in each.items()}
            differ[list(of_number)] = True
            del array, found, each
            out = []
            for chunk, numbers, own, n, n_runs, spread, runs, starts in held:
                m, starts = unpacked(runs, n, "<u4").astype(np.int64), unpacked(starts, n_runs, "<u4")
                of = np.repeat(numbers, m)
                asked = np.repeat(earliest[numbers] < own + unpacked(spread, n, "<u8").astype(np.int64), m)
                whole, parts = asked & ~differ[of], asked & differ[of]
                if asked.any():
                    values = np.concatenate([of_number[i] for i in of[parts].tolist()] or [np.zeros(0, np.int64)])
                    out.append((chunk, int(whole.sum()), int(parts.sum()), len(values), *map(packed, (starts[whole], counts[of[whole]].astype(np.uint8), earliest[of[whole]], starts[parts], counts[of[parts]].astype(np.uint8), values))))
                if len(out) == 64:
                    yield answers(out)
                    out = []
            yield answers(out)

    def answers(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 10
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:4]), *(pa.array(c, pa.binary()) for c in columns[4:])], names=_names(ANSWERS))

    return run


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """Rows of each share, one by one; each share's are to be read before the next."""
    rows = (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        share = ahead["share"]

        def own() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["share"] == share:
                yield ahead
                ahead = next(rows, None)

        yield own()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(length: int, keep_text: bool):
    """Rows of a chunk without the bytes of strings that an earlier document has."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        rows = chunk_rows(chunk)
        base = places(rows, length)
        docs = np.array([np.iinfo(np.int64).min if d is None else d for d, _ in rows], np.int64)

        def spans(starts: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
            later = least < docs[np.searchsorted(base, starts, side="right") - 1]
            return np.stack([starts[later], starts[later] + sizes[later] + length - 1], axis=1)

        every = [np.zeros((0, 2), np.int64)]
        for row in found.to_pylist():
            n, parts = row["n"], row["n_parts"]
            every.append(spans(unpacked(row["starts"], n, "<u4").astype(np.int64), unpacked(row["counts"], n, "u1").astype(np.int64), unpacked(row["least"], n, "<i8")))
            sizes = unpacked(row["part_counts"], parts, "u1").astype(np.int64)
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.repeat(unpacked(row["part_starts"], parts, "<u4").astype(np.int64), sizes) + step
            every.append(spans(at, np.ones(len(at), np.int64), unpacked(row["values"], row["n_values"], "<i8")))
        gone = np.concatenate(every)
        gone = merge_spans(gone) if len(gone) else gone
        own = np.searchsorted(gone[:, 0], base)
        out = []
        for r, (doc_id, text) in enumerate(rows):
            kept, end = text, 0
            if own[r + 1] > own[r]:
                pieces = []
                for a, e in (gone[own[r] : own[r + 1]] - base[r]).tolist():
                    pieces.append(text[end:a])
                    end = e
                kept = b"".join([*pieces, text[end:]])
            out.append((doc_id, len(text), len(text) - len(kept), int(own[r + 1] - own[r]), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        columns = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=_names(RESULT))

    return run


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 20, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id; texts are UTF-8
    bytes, judged as they came in. ``kept`` are the remaining bytes if ``keep_text``, which may end within a character.
    Null texts are empty; a null doc_id neither removes nor loses anything; rows with equal ids don't remove from each
    other; repeated rows are kept. An empty table gives an empty result. Other columns are ignored. ``length`` is at most
    255 and more than ``k``.

    The text is dealt out once, by chunks, and that exchange serves all three steps; what goes to shares and back goes by
    chunk, so that a suffix on very many rows is a few bytes for each chunk. There are as many shares as the texts' bytes
    ask for. A suffix that begins alike in very many documents is dealt out by its strings instead of its first bytes.
    """
    if not k < length < 256:
        raise ValueError("length must be more than k, and at most 255")
    spark = docs.sparkSession
    bounded_batches(spark)
    size = text_bytes(docs)
    n = max(shuffle_partitions(spark), -(-size // SHARE_BYTES))
    chunks = chunked(docs, size)
    counted = chunks.groupBy("chunk").applyInArrow(_fingerprints(length, k, n), COUNTS)
    shared = counted.repartitionById(n, F.col("share")).sortWithinPartitions("share", "chunk").mapInArrow(_repeated, REPEATED)
    arrays = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_suffix_arrays(length, k, n), ARRAYS)
    answers = arrays.repartitionById(n, F.col("share")).sortWithinPartitions("share", "chunk").mapInArrow(_merge_scan(length, k), ANSWERS)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(length, keep_text), RESULT)
