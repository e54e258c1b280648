"""Token ids in binary blocks: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart.

A block holds neighbouring documents. Its ids are ranked by their frequency in the block (ties by id); a rank takes one
to four bytes, as many as it needs. Four lengths go into one control byte, two bits each; all control bytes stand before
all data bytes, so that numpy decodes a block by looking control bytes up in a table, without a loop over ids. The
rank table stands in the block, so each block is read by itself. Blocks are rows of Parquet files: writing them is
Spark's commit, which survives lost tasks, in any store that Spark writes to.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, bounded_batches, scratch_path, shuffle_partitions

#: For each control byte: the four lengths and their sum.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
TOTALS = LENGTHS.sum(axis=1, dtype=np.int64)


class Coded(NamedTuple):
    table: bytes
    control: bytes
    data: bytes


def encode_ids(ids: np.ndarray) -> Coded:
    """Code ``ids`` (below 2**32)."""
    ids = ids.astype(np.uint32)
    if ids.max(initial=0) < 1 << 20:
        counts = np.bincount(ids)
        values, inverse = np.flatnonzero(counts), ids
        counts, place = counts[values], values
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        place = np.arange(len(values))
    order = np.lexsort((values, -counts))
    rank_of = np.zeros(int(place.max(initial=-1)) + 1, np.uint32)
    rank_of[place[order]] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[inverse]
    n = len(ranks)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < lengths[:, None]]
    return Coded(values[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes())


def decode_ids(coded: Coded, n: int) -> np.ndarray:
    """Inverse of :func:`encode_ids` for ``n`` ids: lengths by table lookup, then one gather for each byte of a code."""
    lengths = LENGTHS[np.frombuffer(coded.control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts, data = ends - lengths, np.frombuffer(coded.data, np.uint8)
    ranks = data[starts].astype(np.uint32)
    for byte in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > byte)
        ranks[more] |= data[starts[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return np.frombuffer(coded.table, "<u4")[ranks]


#: Fixed values of a tokenizer file whose ids :class:`Encoder` can put together from parts: its words, and how texts are changed first.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def in_parts(form: dict) -> bool:
    """Whether a tokenizer, read from its file, works word by word in the way that :class:`Encoder` needs."""
    model, before = form["model"], form.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}]
    words = {k: steps[0].get(k) for k in ("type", "pattern", "behavior", "invert")}
    return (
        (form.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and words == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
        and (model["type"], model.get("end_of_word_suffix"), model.get("continuing_subword_prefix"), model.get("dropout")) == ("BPE", "</w>", None, None)
        and all(re.fullmatch(r"<\|\w+\|>", x["content"]) for x in form.get("added_tokens", ()))
    )


class Encoder:
    """Ids of whole texts by the tokenizers library; for a tokenizer that works word by word, from ids of distinct parts.

    Such a tokenizer never joins characters across a space or a line end, so a text's ids are those of its parts between
    them, in order. Parts seen before are looked up; new ones of many texts are encoded in one call. Where one ends shows in the ids
    themselves: the vocabulary marks the last id of each word, and a part of plain form has a known number of words. Other
    parts are encoded one by one. The memory of parts is emptied when it holds more than ``limit``. Whether a tokenizer is
    of that kind is read from its file (:func:`in_parts`); any other gets whole texts.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.in_parts = in_parts(json.loads(self.tokenizer.to_str()))
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.last = np.zeros(size, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.clear()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One for each Python worker, kept from task to task."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def clear(self) -> None:
        self.places = _Places()
        self.starts, self.lengths, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if not self.in_parts:
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.places) > self.limit:
            self.clear()
        counts, parts = [], []
        for t in texts:
            own = _plain(t).replace("\n", " ").split(" ")
            counts.append(len(own))
            parts += own
        at = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        self._learn()
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        gather = np.repeat(self.starts[at] - (ends - lengths), lengths)
        gather += np.arange(len(gather))
        flat = self.tokens[gather]
        text_ends = ends[np.cumsum(counts) - 1].tolist()
        return [flat[s:e] for s, e in zip([0, *text_ends], text_ends)]

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        if not new:
            return
        n_words = [_word_count(x) for x in new]
        plain = [i for i, n in enumerate(n_words) if n]
        lengths, found = np.zeros(len(new), np.int64), [np.zeros(0, self.kind)]
        order: list[int] = []
        for at in range(0, len(plain), 8192):
            own = plain[at : at + 8192]
            ids = self._encode(" ".join([new[i] for i in own]))
            ends = np.flatnonzero(self.last[ids]) + 1
            wanted = np.cumsum([n_words[i] for i in own])
            if len(ends) != wanted[-1]:  # a part had more words than its form tells
                for i in own:
                    n_words[i] = 0
                continue
            lengths[own] = np.diff(ends[wanted - 1], prepend=0)
            found.append(ids)
            order += own
        for i, n in enumerate(n_words):
            if not n:
                found.append(self._encode(new[i]))
                lengths[i] = len(found[-1])
                order.append(i)
        starts = np.empty(len(new), np.int64)
        starts[order] = len(self.tokens) + np.cumsum(lengths[order]) - lengths[order]
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.tokens = np.concatenate([self.tokens, *found])

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)


_ENCODERS: dict[str, Encoder] = {}
_ASCII_WORDS = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\s]+")


#: A stop or comma between a letter and white space is a word of its own.
_STOP = re.compile(r"[.,](?<=[a-z\xdf-\xf6\xf8-\xff][.,])(?=[ \n])")


def _plain(text: str) -> str:
    """``text`` with the same ids but fewer distinct parts: in lower case, as the tokenizer has it, and stops set apart.

    Only for texts of Latin-1 letters, whose lower case nothing but the letter decides.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else _STOP.sub(r" \g<0>", text.lower())


def _word_count(part: str) -> int:
    """How many words the tokenizer makes of ``part``, at least, and exactly that if it is ASCII; 0: not known."""
    if part.isalpha():
        return 1
    if part.isascii() and "'" not in part and "<|" not in part:
        return len(_ASCII_WORDS.findall(part))
    return 0


class _Places(dict):
    """Numbers of parts in the order of their first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self[part] = n = len(self)
        return n


BLOCK = "shard int, block int, before long, n_docs long, n_ids long, doc_ids binary, null_ids binary, doc_lengths binary, table binary, control binary, data binary"


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 20) -> None:
    """Encode every row of ``docs`` and write the blocks to ``path``, in ascending (doc_id, hash of the text) order over shards.

    A shard is a range of that order, so rows of one doc_id may be in several. Each block says how many ids of its shard are
    before it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.shared(tokenizer_path), np.array([end_id], np.uint32)
        ids: list[np.ndarray] = []
        docs_of: list[int | None] = []
        shard, block, before, held = 0, 0, 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                shard = part.column(0)[0].as_py()
                for doc_id, own in zip(part.column(1).to_pylist(), encoder.ids(as_text(part.column(2)))):
                    if docs_of and held >= block_ids:
                        yield _block(shard, block, before, docs_of, ids)
                        ids, docs_of, block, before, held = [], [], block + 1, before + held, 0
                    ids.append(np.concatenate([own, end]).astype(np.uint32))
                    docs_of.append(doc_id)
                    held += len(ids[-1])
        if docs_of:
            yield _block(shard, block, before, docs_of, ids)

    n = max(shuffle_partitions(spark), 4)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("h"))
    ordered = rows.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("h"))
    ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(run, BLOCK).write.parquet(path)


def _block(shard: int, block: int, before: int, doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    coded = encode_ids(np.concatenate(ids))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    lengths = np.array([len(x) for x in ids], "<i8")
    row = [shard, block, before, len(ids), int(lengths.sum()), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes() if nulls.any() else b"", lengths.tobytes(), *coded]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the blocks at ``path``.

    ``start`` is the number of ids of all documents before it: those of the shards before, added up over one row for each
    shard, and those before its block, which the block says. ``ids`` are unsigned 32-bit; as int64 array is four times
    their size it stays binary.
    """
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_shards"))
    placed = files.join(F.broadcast(shards), "shard")  # as many rows as shards were written
    own = placed.select((F.col("of_shards") + F.col("before")).alias("start"), "n_ids", "doc_ids", "null_ids", "doc_lengths", "table", "control", "data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = decode_ids(Coded(row["table"], row["control"], row["data"]), row["n_ids"]).astype("<u4")
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                nulls = np.frombuffer(row["null_ids"], np.uint8).astype(bool) if row["null_ids"] else None
                own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=nulls), pa.array(ends - lengths + row["start"]), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return own.mapInArrow(run, READ)


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token blocks in the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32, ids).

    Null and empty texts have the end id alone; null doc_ids come first; rows of one doc_id are ordered by a hash of their
    texts, so repeated rows follow each other. An empty table gives an empty result. Other columns are ignored.
    """
    path = scratch_path(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, path, tokenizer_path, end_id)
    return read_token_blocks(docs.sparkSession, path)
