"""Intermediate tables, written Feather files, arrays that models take."""

import os

import pytest
from pyspark.sql import functions as F

from eventide.operators import matrix, preprocess
from eventide.sources import events as sources
from eventide.sources import scratch


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="share"):
        scratch.shared_dir(Session())


def test_intermediate_tables_are_read_again_and_deleted(spark):
    before = len(scratch._WRITTEN)
    rows = scratch.materialize(spark.range(5), "t")
    path = scratch._WRITTEN[-1]
    assert rows.count() == 5 and os.path.isdir(path)
    kept, scratch._WRITTEN[:] = scratch._WRITTEN[:before], scratch._WRITTEN[before:]
    assert scratch.clear(spark) == 1 and not os.path.exists(path)
    scratch._WRITTEN[:] = kept


def test_feather_is_written_by_tasks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), "id")).alias("s")).repartition(5)
    paths = sources.write_feather(rows, str(tmp_path / "out"))
    assert len(paths) == 5 and sorted(os.listdir(tmp_path / "out")) == [os.path.basename(p) for p in paths]
    assert sources.read_feather(spark, *paths).exceptAll(rows).count() == 0 and sources.read_feather(spark, *paths).count() == 1000
    assert sources.write_feather(rows.limit(0), str(tmp_path / "none")) == []


def test_row_ids_are_the_keys(spark):
    rows = spark.createDataFrame([("1:2", 3, 1, 0), ("2", 31, 1, 0), ("2", 3, 2, 1)], "patient_id string, year int, a long, DEATH long")
    assert sorted(r["row_id"] for r in matrix.feature_arrays(rows, ["a"]).collect()) == ["31:2", "3:1:2", "3:2"]


def test_arrays_are_imputed_and_standardised_by_position(spark):
    rows = spark.createDataFrame([(1, [1.0, None, 5.0, None]), (2, [2.0, 4.0, 5.0, None]), (3, [float("nan"), 8.0, 5.0, None]), (4, [6.0, 6.0, 5.0, None])], "row_id int, features array<double>")
    found = {r["row_id"]: r["features"] for r in preprocess.normalised(rows).collect()}
    first = [1.0, 2.0, 2.0, 6.0]  # the median stands in
    mean, deviation = sum(first) / 4, (sum((x - sum(first) / 4) ** 2 for x in first) / 4) ** 0.5
    assert [found[i][0] for i in (1, 2, 3, 4)] == pytest.approx([(x - mean) / deviation for x in first])
    assert found[1][1] == pytest.approx(0.0) and all(f[2:] == [0.0, 0.0] for f in found.values())
