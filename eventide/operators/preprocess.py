"""Wide tables: outcome, imputation, standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import medians


def with_outcome(table: DataFrame, outcome: str, drops: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose ``outcome`` is known, which comes last under that name, without the columns in ``drops`` that are there."""
    own = table.drop(*[d for d in drops if d != outcome]).na.drop(subset=[outcome])
    return own.select(*[c for c in own.columns if c != outcome], F.col(outcome).alias("outcome"))


def split_outcome(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.drop("outcome"), table.select("outcome")


def _numbers(columns: list[str]) -> dict[str, F.Column]:
    return {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}


def impute_median(rows: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls and NaNs in ``columns`` become the exact median of the column, of ``fit_on`` if given, else of ``rows``.

    A column without any value is dropped. The medians, a row for each column, come to the driver and go into the plan as
    literals; no task holds a column's values.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), v.alias("value")) for i, v in enumerate(_numbers(columns).values())]))
    known = {columns[r["column"]]: r["median"] for r in medians((rows if fit_on is None else fit_on).select(cells.alias("c")).select("c.column", "c.value"), "column", "value").collect()} if columns else {}
    filled = {c: F.coalesce(v, F.lit(known[c])) for c, v in _numbers(columns).items() if c in known}
    return rows.withColumns(filled).drop(*[c for c in columns if c not in known])


def standardise(rows: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation of the column; a constant column becomes zero, nulls stay."""
    own = rows if fit_on is None else fit_on
    moments = own.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for c in columns:
        mean, deviation = moments[f"m_{c}"], moments[f"s_{c}"]
        out[c] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(deviation) if deviation else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return rows.withColumns(out)


def normalised(rows: DataFrame, column: str = "features") -> DataFrame:
    """``rows`` with the array ``column`` imputed by its positions' medians, then standardised, both of these rows alone.

    Nulls and NaNs are missing; a position without any value or deviation becomes zero. What is worked out for each
    position, a row for each, comes to the driver and goes into the plan as literals. Arrays have one length.
    """
    value = F.nullif(F.col("v").cast("double"), F.lit(float("nan")))
    cells = rows.select(F.posexplode(column).alias("pos", "v")).select("pos", value.alias("v"))
    found = {r["pos"]: r["median"] for r in medians(cells, "pos", "v").collect()}
    width = rows.agg(F.max(F.size(column))).first()[0] or 0
    known = F.array(*[F.lit(found.get(i, 0.0)) for i in range(width)]).cast("array<double>")
    filled = F.zip_with(F.col(column).cast("array<double>"), known, lambda v, m: F.coalesce(F.nullif(v, F.lit(float("nan"))), m))
    own = rows.withColumn(column, filled)
    moments = {r["pos"]: (r["mean"], r["deviation"]) for r in own.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).collect()}
    scale = F.array(*[F.struct(F.lit(moments[i][0]).alias("mean"), F.lit(moments[i][1] or None).cast("double").alias("deviation")) for i in sorted(moments)]) if moments else F.array().cast("array<struct<mean:double,deviation:double>>")
    return own.withColumn(column, F.zip_with(F.col(column), scale, lambda v, s: F.coalesce((v - s["mean"]) / s["deviation"], F.lit(0.0))))
