"""Event logs: readers, and the canonical form (patient_id, date, year, event)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowfiles import located, read_feather  # noqa: F401  the scan of Feather files


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_feather(rows: DataFrame, folder: str) -> list[str]:
    """Feather files of ``rows`` in ``folder``, one written by each task that has rows; their paths, for :func:`read_feather`.

    The folder may be local or a URI that Arrow's file systems know; all machines must reach it. A task that is run again
    writes its file again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = located(folder)
        store.create_dir(root)
        name = f"{root.rstrip('/')}/part-{task.partitionId():06}.feather"
        own, sink, writer = f"{name}.{task.taskAttemptId()}", None, None
        for b in batches:
            if b.num_rows:
                if writer is None:
                    sink = store.open_output_stream(own)
                    writer = pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                writer.write_batch(b)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/part-{task.partitionId():06}.feather"])], names=["path"])

    return sorted(r["path"] for r in rows.mapInArrow(run, "path string").collect())  # a path for each task


def canonical_events(log: DataFrame, entity: str = "patient_id", date: str = "date", event: str = "event", period: Column | None = None) -> DataFrame:
    """(patient_id string, date timestamp_ntz, year int, event string) of a log; other columns are left behind.

    ``period`` is an integer expression of another grain than the year. A null entity or date fails the run when the row
    is read; a null event stays null and is neither terminal nor a feature.
    """
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"event log: null {c}")))
    own = log.select(known(entity).cast("string").alias("patient_id"), known(date).cast("timestamp_ntz").alias("date"), F.col(event).cast("string").alias("event"))
    return own.select("patient_id", "date", (F.year("date") if period is None else period).cast("int").alias("year"), "event")


def is_terminal(pattern: str, event: str = "event") -> Column:
    """Whether ``pattern`` is found anywhere in the event; a null event isn't terminal."""
    return F.coalesce(F.col(event).rlike(pattern), F.lit(False))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an event log: customers, order dates, kinds of parts; large returned quantities are terminal."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    rows = lines.join(read("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    terminal = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 48)
    named = rows.withColumn("event", F.when(terminal, F.lit("DEATH")).otherwise(F.concat("p_type", F.lit("/"), "p_brand")))
    return canonical_events(named, entity="o_custkey", date="o_orderdate")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an event log by day (yyyymmdd in ``year``); errors above 150 are terminal."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    terminal = (F.col("event_type") == "error") & (F.col("value") > 150)
    named = log.withColumn("event", F.when(terminal, F.lit("DEATH")).otherwise(F.col("event_type")))
    return canonical_events(named, entity="user_id", date="ts", period=F.date_format("date", "yyyyMMdd").cast("int"))
