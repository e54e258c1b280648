"""SimHash near-duplicates: fingerprints of word shingles, linked by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d bits agree in at least 8 - d of their 8 bytes. The index posts each
distinct fingerprint under sets of byte positions chosen so that every pair with the guaranteed number of shared
positional bytes meets under at least one of them. Within a posting list the shared positional bytes of a pair are
tallied; pairs under the guaranteed minimum go, the others are verified bit by bit. A list longer than ``list_limit`` is
posted anew under further bits (its members agree in the posted ones, so at least one of d + 1 parts of the rest must be
equal too), which keeps every list bounded and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, bounded_batches, materialize, shuffle_partitions
from .components import components


def shingles(text: bytes, k: int) -> list[bytes]:
    """Word ``k``-shingles of A-Z-lowered ``text``, repeats included; with fewer words, the whole sequence; without any, none."""
    words = text.translate(LOWER).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - k].tolist()]
    return [joined[s:e] for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())]


def simhash(text: bytes, k: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    found = shingles(text, k)
    if not found:
        return 0
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, seed) for s in found], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) as longs for every row of ``docs``; a null text has no words and gets fp 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, k, seed) for t in as_bytes(b.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def position_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``shared`` of the 8 positions contain one: a greedy cover."""
    need = {frozenset(c) for c in combinations(range(8), shared)}
    sets = [frozenset(c) for c in combinations(range(8), size)]
    chosen = []
    while need:
        best = max(sets, key=lambda s: sum(s <= n for n in need))
        chosen.append(tuple(sorted(best)))
        need = {n for n in need if not best <= n}
    return chosen


def mask_of(positions: Iterable[int]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(mask: int, n: int) -> list[int]:
    """The bits outside ``mask``, in ``n`` disjoint masks."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << b for b in part) for part in np.array_split(free, n) if len(part)]


def link_list(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the members of one posting list at ``distance`` or fewer bits: tally, filter, verify.

    Only links that join two parts not yet joined are given, so a list gives fewer links than it has members.
    """
    n, least = len(fps), 8 - distance
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shape, out = fps.view(np.uint8).reshape(n, 8), []
    for i in range(n - 1):
        tally = (shape[i + 1 :] == shape[i]).sum(axis=1)
        near = np.flatnonzero(tally >= least) + i + 1
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= distance]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def near_links(fps: DataFrame, distance: int = 3, list_limit: int = 4096) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) of ``fps`` that span all pairs at ``distance`` or fewer bits."""
    spark = fps.sparkSession
    masks = [mask_of(s) for s in position_sets(8 - distance, min(4, 8 - distance))]
    postings = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    links = None
    while True:
        n = shuffle_partitions(spark)
        postings = postings.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))).repartition(n, "mask", "part").sortWithinPartitions("mask", "part", "fp")
        listed = materialize(postings.mapInArrow(_scan(distance, list_limit), "a long, b long, fp long, mask long"), "simhash-lists")
        found = listed.where("fp is null").select("a", "b")
        links = found if links is None else links.union(found)
        long_lists = [r[0] for r in listed.where("fp is not null").select("mask").distinct().collect()]  # masks, not documents
        if not long_lists:
            return links
        finer = F.lit(None).cast("array<bigint>")
        for m in long_lists:
            own = m & (1 << 64) - 1
            finer = F.when(F.col("mask") == m, F.array(*[F.lit(_signed(own | p)) for p in _parts(own, distance + 1)])).otherwise(finer)
        postings = listed.where("fp is not null").select("fp", F.explode(finer).alias("mask")).distinct()


def _scan(distance: int, list_limit: int):
    """Over postings sorted by list: links of each list, or the members of a list that is too long and can be made finer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]], fps: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            n, m = len(pairs), len(fps)
            none = lambda k: pa.nulls(k, pa.int64())
            cols = [pa.concat_arrays(x) for x in ([pa.array(pairs[:, 0]), none(m)], [pa.array(pairs[:, 1]), none(m)], [none(n), pa.array(fps)], [none(n), pa.array(masks)])]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "fp", "mask"])

        held: list[np.ndarray] = []
        key, size, passing = None, 0, False
        empty = np.zeros(0, np.int64)

        def flush() -> list[tuple[int, int]]:
            own = np.concatenate(held) if held else empty
            return link_list(np.unique(own).view(np.uint64), distance) if size > 1 and not passing else []

        for b in batches:
            fp, mask, part = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            links: list[tuple[int, int]] = []
            longs: list[tuple[np.ndarray, int]] = []
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            edge = {0, len(starts) - 1}
            for i in np.union1d(np.flatnonzero(ends - starts > 1), list(edge)).tolist():  # lists of one row have no link
                s, e = int(starts[i]), int(ends[i])
                if (mask[s], part[s]) != key:
                    links += flush()
                    held, size, passing, key = [], 0, False, (mask[s], part[s])
                held.append(fp[s:e])
                size += e - s
                finer = 64 - (int(mask[s]) & (1 << 64) - 1).bit_count() > 12
                if finer and (passing or size > list_limit):
                    longs.append((np.concatenate(held), int(mask[s])))
                    held, passing = [], True
            yield out(links, np.concatenate([x for x, _ in longs]) if longs else empty, np.concatenate([np.full(len(x), m) for x, m in longs]) if longs else empty)
        yield out(flush(), empty, empty)

    return run


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, distance: int = 3, list_limit: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable over links,
    the row's own included. Equal fingerprints are one node, so copies aren't expanded into pairs. A null text counts as
    one without words (fingerprint zero). A null doc_id is linked as any other but never names a component unless all
    ids of its component are null; repeated rows are kept. An empty table gives an empty result. Other columns are ignored.
    """
    found = _linked(docs, k, seed, distance, list_limit)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _linked(docs: DataFrame, k: int, seed: int, distance: int, list_limit: int) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id) for every row; group is a fingerprint that names the component."""
    bounded_batches(docs.sparkSession)
    own = materialize(fingerprints(docs, k, seed), "simhash")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = components(near_links(distinct.select("fp"), distance, list_limit), "simhash-links")
    named = linked.join(distinct, linked["node"] == distinct["fp"]).groupBy("component").agg(F.min("first_id").alias("linked_id"))
    ids = materialize(distinct.join(linked, distinct["fp"] == linked["node"], "left").join(named, "component", "left").select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("linked_id", "first_id").alias("component_id")), "simhash-ids")
    return own.join(ids, "fp", "left").select("doc_id", "text_hash", "fp", "group", "component_id")


def one_of_each(docs: DataFrame, k: int = 3, seed: int = 42, distance: int = 3, list_limit: int = 4096) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the smallest doc_id, ties by hash of the text.

    Groups are those of :func:`near_duplicates`; repeated rows are one group. A group whose ids are all null keeps a row too.
    """
    linked = _linked(docs, k, seed, distance, list_limit)
    first = F.min_by("text_hash", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash")))
    kept = linked.groupBy("group").agg(F.min("doc_id").alias("doc_id"), first.alias("hash"))
    names = ["_id", "_none", "_hash"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [f"{n}_" for n in names]
    key = lambda hash_: [F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), hash_.alias(names[2])]
    # no key is null, so that the texts are dealt out once for both the join and the repeated rows
    rows = docs.select("*", *key(F.xxhash64("text"))).join(kept.select(*key(F.col("hash"))), names, "left_semi")
    return rows.dropDuplicates(names).select(*docs.columns)
