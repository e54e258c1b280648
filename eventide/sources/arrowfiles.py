"""Python data sources over Arrow's file systems: a scan of Feather files, and a sink that appends each run's rows once.

Paths are local or URIs that Arrow's file systems know; all machines must reach them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a Feather file that one task reads, about.
SLICE_BYTES = 64 << 20


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and its name there."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def opened(path: str, columns: list[str] | None = None) -> pa.ipc.RecordBatchFileReader:
    """A Feather file; of ``columns``, if given, only the bytes of these are read."""
    store, name = located(path)
    whole = pa.ipc.open_file(store.open_input_file(name))
    if columns is None:
        return whole
    return pa.ipc.open_file(store.open_input_file(name), options=pa.ipc.IpcReadOptions(included_fields=[whole.schema.get_field_index(c) for c in columns]))


def plain(schema: pa.Schema) -> pa.Schema:
    """Dictionaries as what they stand for, times in microseconds."""

    def kind(t: pa.DataType) -> pa.DataType:
        t = t.value_type if pa.types.is_dictionary(t) else t
        return pa.timestamp("us", t.tz) if pa.types.is_timestamp(t) else t

    return pa.schema([pa.field(f.name, kind(f.type), f.nullable) for f in schema])


#: Comparisons that a scan can make on a batch; what Spark compares otherwise stays with Spark.
TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def passing(batch: pa.RecordBatch, test: Filter) -> pa.Array:
    column = batch.column(test.attribute[0])
    if isinstance(test, IsNull):
        return pc.is_null(column)
    if isinstance(test, IsNotNull):
        return pc.is_valid(column)
    if isinstance(test, In):
        return pc.and_(pc.is_valid(column), pc.is_in(column, pa.array(list(test.value), column.type)))
    return TESTS[type(test)](column, pa.scalar(test.value, column.type))


def can_test(schema: StructType, test: Filter) -> bool:
    """Whether Arrow and Spark agree on it: on numbers without NaN, strings and dates, at the top level."""
    if type(test) not in (*TESTS, In, IsNull, IsNotNull) or len(test.attribute) > 1:
        return False
    return isinstance(test, (IsNull, IsNotNull)) or schema[test.attribute[0]].dataType.typeName() in ("string", "byte", "short", "integer", "long", "date", "boolean")


@dataclass
class FeatherSlice(InputPartition):
    """Record batches ``at``, ``at + of``, ... of a file."""

    path: str
    at: int
    of: int


class FeatherReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.schema, self.tests = paths, schema, []

    def partitions(self) -> list[FeatherSlice]:
        """By the files' sizes alone; their footers are read by the tasks."""
        out = []
        for path in self.paths:
            store, name = located(path)
            n = max(1, -(-store.get_file_info(name).size // SLICE_BYTES))
            out += [FeatherSlice(path, i, n) for i in range(n)]
        return out

    def read(self, partition: FeatherSlice) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        file = opened(partition.path, self.schema.fieldNames())
        for i in range(partition.at, file.num_record_batches, partition.of):
            own = pa.Table.from_batches([file.get_batch(i)])
            own = pa.table([own.column(f.name).cast(f.type, safe=False) for f in want], schema=want)
            for b in own.to_batches():
                keep = None
                for test in self.tests:
                    found = passing(b, test)
                    keep = found if keep is None else pc.and_kleene(keep, found)
                yield b if keep is None else b.filter(keep)


class ComparingReader(FeatherReader):
    """Spark refuses a reader that takes comparisons over where the session doesn't let it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if can_test(self.schema, f):
                self.tests.append(f)
            else:
                yield f


class FeatherSource(DataSource):
    """Feather files of one schema: that of the first one. Options: ``paths``, a list in JSON; ``compare``, whether the scan makes comparisons."""

    @classmethod
    def name(cls) -> str:
        return "feather_files"

    def schema(self) -> StructType:
        return from_arrow_schema(plain(opened(json.loads(self.options["paths"])[0]).schema), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> FeatherReader:
        kind = ComparingReader if self.options.get("compare") == "true" else FeatherReader
        return kind(json.loads(self.options["paths"]), schema)


def read_feather(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of Feather (Arrow IPC) files of one schema; with ``columns`` only these are read from the files.

    The driver reads the first file's schema and all files' sizes, tasks read record batches. Comparisons are made by the
    scan where the session has spark.sql.python.filterPushdown.enabled.
    """
    spark.dataSource.register(FeatherSource)
    scan = spark.read.format("feather_files").option("paths", json.dumps(paths)).option("compare", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if columns is not None:
        whole = from_arrow_schema(plain(opened(paths[0]).schema), prefer_timestamp_ntz=True)
        scan = scan.schema(StructType([whole[c] for c in columns]))
    return scan.load()


@dataclass
class Staged(WriterCommitMessage):
    rows: int


class RunWriter(DataSourceArrowWriter):
    """A run's rows as CSV files, first under a hidden name; committing renames the folder, which other readers see whole or not at all."""

    def __init__(self, path: str, run: str):
        self.path, self.run = path, run
        self.staging = f"_staging-{run}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        store, root = located(self.path)
        task = TaskContext.get()
        folder, rows, writer = f"{root}/{self.staging}", 0, None
        store.create_dir(folder)
        name = f"{folder}/part-{task.partitionId():06}.csv"
        own = f"{folder}/.{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(own) as sink:
            for b in iterator:
                if b.num_rows:
                    writer = writer or pyarrow.csv.CSVWriter(sink, b.schema, write_options=pyarrow.csv.WriteOptions(include_header=False))
                    writer.write_batch(b)
                    rows += b.num_rows
            if writer is not None:
                writer.close()
        store.move(own, name) if rows else store.delete_file(own)
        return Staged(rows)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = located(self.path)
        staged, done = f"{root}/{self.staging}", f"{root}/run={self.run}"
        known = store.get_file_info(done).type != pyarrow.fs.FileType.NotFound
        if known or not sum(m.rows for m in messages if m is not None):
            self.abort(messages)
        else:
            store.move(staged, done)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = located(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class RunSink(DataSource):
    """Appends rows as CSV. Options: ``path``, ``run``."""

    @classmethod
    def name(cls) -> str:
        return "csv_runs"

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("csv_runs only appends")
        return RunWriter(self.options["path"].rstrip("/"), self.options["run"])


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """Rows appended as CSV without a header, in a folder of their own; a ``run`` that is there already adds nothing.

    What a failed or lost attempt left is never read, as its folder's name starts with an underscore.
    """
    if not run or not all(c.isalnum() or c in "-_." for c in run):
        raise ValueError("a run is named by letters, digits, '-', '_' and '.'")
    rows.sparkSession.dataSource.register(RunSink)
    rows.write.format("csv_runs").mode("append").option("path", path).option("run", run).save()


def read_runs(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """Rows of all runs, with their ``run``."""
    return spark.read.schema(StructType([*schema.fields]).add("run", "string")).csv(path)
