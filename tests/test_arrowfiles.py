"""The Feather scan and the sink of runs."""

import glob
import os

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from eventide.sources import arrowfiles, sinks
from eventide.sources import events as sources


@pytest.fixture
def files(tmp_path):
    paths = [str(tmp_path / f"{i}.feather") for i in range(3)]
    for i, p in enumerate(paths):
        n = 100 * i  # the first one has no rows
        table = pa.table({"a": pa.array(range(n), pa.int64()), "s": pa.array([None, "x", "y", "x"][: min(n, 4)] * (n // 4)).dictionary_encode() if n else pa.array([], pa.string()).dictionary_encode(), "t": pa.array(list(range(n)), pa.timestamp("ns"))})
        feather.write_feather(table, p, chunksize=7)
    return paths


def test_scan(spark, files, monkeypatch):
    monkeypatch.setattr(arrowfiles, "SLICE_BYTES", 500)
    found = sources.read_feather(spark, *files)
    assert dict(found.dtypes) == {"a": "bigint", "s": "string", "t": "timestamp_ntz"}
    assert sorted(r["a"] for r in found.collect()) == sorted([*range(100), *range(200)]) and found.where("s is null").count() == 75
    few = sources.read_feather(spark, *files, columns=["s"])
    assert few.columns == ["s"] and few.where("s = 'x'").count() == 150
    assert sources.read_feather(spark, files[0]).count() == 0


def test_comparisons_made_by_the_scan(spark, files):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for test, n in (("a >= 90", 120), ("a < 10 and s = 'x'", 10), ("s is null", 75), ("a in (1, 5, 500)", 4), ("s is not null and a = 4", 0), ("a + 1 = 4", 2), ("s like 'y%' and a > 150", 12)):
            own = sources.read_feather(spark, *files).where(test)
            assert own.count() == n, test
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_what_arrow_compares_like_spark_is_taken_over(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, StringContains
    from pyspark.sql.types import StructType

    reader = arrowfiles.ComparingReader([], StructType.fromDDL("a long, d double, n struct<x: int>"))
    left = list(reader.pushFilters([EqualTo(("a",), 1), GreaterThan(("d",), 1.0), IsNull(("d",)), EqualTo(("n", "x"), 1), StringContains(("a",), "x")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo", "StringContains"] and len(reader.tests) == 2


def seen(spark, path):
    return sorted(tuple(r) for r in arrowfiles.read_runs(spark, spark.range(0).schema, path).collect())


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    for run in ("a", "b", "a"):
        sinks.append_metrics(spark.range(2).repartition(2), path, run)
    assert seen(spark, path) == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]
    sinks.append_metrics(spark.range(0), path, "none")
    assert len(seen(spark, path)) == 4 and not [f for f in os.listdir(path) if f.startswith("_")]
    for name in ("", "a/b", "x=y"):
        with pytest.raises(ValueError):
            sinks.append_metrics(spark.range(1), path, name)


def test_a_run_with_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.append_metrics(spark.range(3), path, "good")
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_metrics(bad, path, "bad")
    assert seen(spark, path) == [(0, "good"), (1, "good"), (2, "good")]
    assert not glob.glob(f"{path}/_staging*")
    sinks.append_metrics(spark.range(1), path, "bad")  # the run is done again
    assert (0, "bad") in seen(spark, path)
