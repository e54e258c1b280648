"""Count matrices: canonical in long form, wide only at the edge to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("patient_id", "year")


def long_counts(events: DataFrame) -> DataFrame:
    """(patient_id, year, event, n): events with a date; repeated events count, a null event has no row."""
    return events.where("event is not null").groupBy(*KEYS, "event").agg(F.count("date").alias("n"))


def pivot_counts(events: DataFrame, values: list[str], present: DataFrame | None = None) -> DataFrame:
    """A row for each entity and period, a column of counts for each of ``values``, zero where absent.

    Entity-periods without any of the values have no row, unless they are in ``present`` (patient_id, year).
    """
    values = list(dict.fromkeys(values))
    wide = events.where(F.col("event").isin(*values)).groupBy(*KEYS).pivot("event", values).agg(F.count("date"))
    if present is not None:
        wide = present.select(*KEYS).distinct().join(wide, list(KEYS), "left")
    return wide.na.fill(0, subset=values)


def align(rows: DataFrame, values: list[str]) -> DataFrame:
    """Exactly the columns patient_id, year and ``values`` in order; those that are missing are zero."""
    have = set(rows.columns)
    return rows.select(*KEYS, *[F.col(f"`{v}`") if v in have else F.lit(0).cast("long").alias(v) for v in values])


def trim_after_terminal(rows: DataFrame, terminal: str = "DEATH") -> DataFrame:
    """Rows up to an entity's first period with a count in ``terminal``, which stays."""
    first = F.min(F.when(F.col(f"`{terminal}`") > 0, F.col("year"))).over(W.partitionBy("patient_id"))
    return rows.withColumn("_first", first).where("_first is null or year <= _first").drop("_first")


def trim_long(counts: DataFrame, terminal: str = "DEATH") -> DataFrame:
    """:func:`trim_after_terminal` of the long form."""
    first = F.min(F.when((F.col("event") == terminal) & (F.col("n") > 0), F.col("year"))).over(W.partitionBy("patient_id"))
    return counts.withColumn("_first", first).where("_first is null or year <= _first").drop("_first")


def labelled(rows: DataFrame, terminal: str = "DEATH") -> DataFrame:
    return rows.withColumn("label", (F.col(f"`{terminal}`") > 0).cast("int"))


def feature_arrays(rows: DataFrame, values: list[str], terminal: str = "DEATH") -> DataFrame:
    """(row_id string, patient_id, year, features array<float>, label): what models take; row_id is the period, then the entity."""
    own = labelled(rows, terminal).select(*KEYS, F.array(*[F.col(f"`{v}`").cast("float") for v in values]).alias("features"), "label")
    return own.select(F.concat_ws(":", F.col("year").cast("string"), "patient_id").alias("row_id"), "*")
