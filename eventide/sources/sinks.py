"""Sinks: tables that are read if already computed, appended metrics and reports, trees as graphs."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .arrowfiles import append_run


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finished writing a table at ``path``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def read_or_compute(spark: SparkSession, root: str, name: str, fingerprint: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` under ``root`` for this ``fingerprint`` of parameters and inputs, computed and written if absent.

    Another fingerprint is another folder, so a change of parameters never reads stale rows. A folder without Spark's
    success mark is from a run that broke off, and is written anew.
    """
    path = f"{root.rstrip('/')}/{name}/{fingerprint}"
    if exists(spark, path):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_metrics(rows: DataFrame, path: str, run: str) -> None:
    """Rows appended as CSV without a header; a ``run`` that was appended before adds nothing."""
    append_run(rows, path, run)


def append_report(path: str, lines: dict[str, object]) -> None:
    """``name: value`` lines appended to a text file of the driver; its folder is made if need be."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(f"{k}: {v}\n" for k, v in lines.items()) + "\n")


def save_weights(spark: SparkSession, weights: dict[str, list[list[float]]], path: str) -> None:
    """Matrices as rows (name, row, values)."""
    rows = [(name, i, [float(x) for x in row]) for name, matrix in weights.items() for i, row in enumerate(matrix)]
    spark.createDataFrame(rows, "name string, row int, values array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    found: dict[str, list[list[float]]] = {}
    for r in spark.read.parquet(path).orderBy("name", "row").collect():  # a model, not data
        found.setdefault(r["name"], []).append(list(r["values"]))
    return found


def tree_graph(debug: str, names: list[str]) -> str:
    """A decision tree's ``toDebugString`` as DOT text, features by name."""
    out: list[str] = []
    tests: dict[int, int] = {}  # by depth: the number of the test that is open there
    for line in debug.splitlines()[1:]:
        depth, text = len(line) - len(line.lstrip()), re.sub(r"feature (\d+)", lambda m: names[int(m[1])], line.strip())
        if text.startswith("Else") or not text:
            continue
        n = sum(x.startswith("  n") and "->" not in x for x in out)
        out.append(f'  n{n} [label="{text.removeprefix("If ").strip("()")}"];')
        above = max((d for d in tests if d < depth), default=None)
        if above is not None:
            out.append(f"  n{tests[above]} -> n{n};")
        if text.startswith("If"):
            tests[depth] = n
    return "digraph tree {\n" + "\n".join(out) + "\n}\n"
