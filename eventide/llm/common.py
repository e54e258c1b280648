"""Helpers that the text operators share: scratch tables in the cluster's shared folder, byte tables, partition counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_path  # noqa: F401  tables that the operators write for themselves

#: ASCII white space (0x20, 0x09-0x0D) is what ``bytes.split()`` splits at.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand texts to Python in batches of at most ``size`` bytes (or one row), not only of so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def fold(column: str, n: int):
    """crc32 of an id as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def chunked(docs: DataFrame, size: int, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(chunk, doc_id, text) with about ``chunk_bytes`` of text in each chunk, of ``size`` in all.

    A chunk is what one task holds in memory at once. Requests and answers go by chunk, so that a value on very many rows
    is sent once for each chunk, not once for each row. Repeated rows part by the partition that they were read in.
    """
    n = max(-(-size // chunk_bytes), 1)
    return docs.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text")


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: sorted ones are alike in most of their bytes."""
    if not len(values):
        return b""
    own = values.view(np.uint8).reshape(-1, values.itemsize)
    planes = np.empty(own.shape[::-1], np.uint8)
    for i in range(values.itemsize):  # ten times as fast as a transposed copy
        planes[i] = own[:, i]
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    own = np.empty((n, size), np.uint8)
    for i in range(size):
        own[:, i] = planes[i]
    return own.view(kind).ravel()


def chunk_rows(chunk: pa.Table) -> list[tuple[int | None, bytes]]:
    """(doc_id, text) of a chunk in an order that its rows alone decide."""
    rows = zip(chunk.column("doc_id").to_pylist(), as_bytes(chunk.column("text").combine_chunks()) if chunk.num_rows else [])
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
