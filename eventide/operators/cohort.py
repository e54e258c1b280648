"""Cohorts: splits of periods and entities, histories up to the terminal event, balanced selections under row caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.events import is_terminal
from ..sources.scratch import materialize


def split_periods(events: DataFrame, forced: tuple[int, ...]) -> DataFrame:
    """(year, is_train) of every period: the ``forced`` ones train if all are there, else the first half does.

    Works on the distinct periods, whose number the calendar bounds.
    """
    years = events.select("year").distinct()
    whole = W.partitionBy(F.lit(0))
    ranked = years.select("year", F.row_number().over(whole.orderBy("year")).alias("rn"), F.count("*").over(whole).alias("n"), F.sum(F.col("year").isin(*forced).cast("int")).over(whole).alias("n_forced"))
    return ranked.select("year", F.when(F.col("n_forced") == len(set(forced)), F.col("year").isin(*forced)).otherwise(F.col("rn") <= F.floor(F.col("n") / 2)).alias("is_train"))


def train_test_periods(events: DataFrame, forced: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """The periods of :func:`split_periods` as two sorted lists; fails if none is left to train on."""
    rows = split_periods(events, forced).orderBy("year").collect()  # periods, not data
    train, test = [r["year"] for r in rows if r["is_train"]], [r["year"] for r in rows if not r["is_train"]]
    if not train:
        raise RuntimeError(f"no period to train on among {test}")
    return train, test


def shuffle_key(seed: int | Column, entity: str = "patient_id") -> Column:
    """What entities are shuffled by: the same order in any engine, on any number of machines."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col(entity)).cast("binary"))


def in_hash_order(rows: DataFrame, key: Column, groups: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """``rows`` with ``rn`` (1, 2, ... by key, then patient_id), ``total`` (rows) and, of ``value``, the running sum ``cum``.

    By group, and exact without sorting a group in one task: ranks within each of 65 536 ranges of the key, plus what all
    ranges before it hold. The offsets have at most one row for each group and range.
    """
    keyed = rows.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 4))
    measure = F.col(value) if value else F.lit(0)
    sums = keyed.groupBy(*groups, "_range").agg(F.count("*").alias("_n"), F.sum(measure).alias("_v"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_of_{g}") for g in groups],
        F.col("_range").alias("_of_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v_before"),
        F.sum("_n").over(whole).alias("total"),
    )
    own = W.partitionBy(*groups, "_range").orderBy("_key", "patient_id")
    ranked = keyed.withColumn("_rn", F.row_number().over(own)).withColumn("_cum", F.sum(measure).over(own.rowsBetween(W.unboundedPreceding, 0)))
    on = ranked["_range"] == offsets["_of_range"]
    for g in groups:
        on &= ranked[g].eqNullSafe(offsets[f"_of_{g}"])
    found = ranked.join(offsets, on)
    extra = [(F.col("_cum") + F.col("_v_before")).cast("long").alias("cum")] if value else []
    return found.select(*rows.columns, (F.col("_rn") + F.col("_n_before")).cast("long").alias("rn"), "total", *extra)


def split_entities(events: DataFrame, seed: int = 42, test_percent: int = 10) -> DataFrame:
    """(patient_id, rn, is_test) of every entity: the first ``test_percent`` of the shuffled entities, rounded up, test."""
    ranked = in_hash_order(events.select("patient_id").distinct(), shuffle_key(seed))
    return ranked.select("patient_id", "rn", (F.col("rn") <= F.ceil(F.col("total") * test_percent / 100)).alias("is_test"))


def within(events: DataFrame, entities: DataFrame | None = None, years: list[int] | None = None, values: DataFrame | list[str] | None = None) -> DataFrame:
    """Events of the given entities, periods and event values; a null event matches no value.

    Entities (and values in a table) are semi-joined, which Spark broadcasts only below its own size limit.
    """
    if years is not None:
        events = events.where(F.col("year").isin(*years))
    if isinstance(values, list):
        events = events.where(F.col("event").isin(*values))
    elif values is not None:
        events = events.join(values.select("event"), "event", "left_semi").select(*events.columns)
    return events if entities is None else events.join(entities.select("patient_id"), "patient_id", "left_semi")


def first_terminal(events: DataFrame, pattern: str) -> DataFrame:
    """(patient_id, terminal_year): the first period with a terminal event, of entities that have one."""
    return events.where(is_terminal(pattern)).groupBy("patient_id").agg(F.min("year").alias("terminal_year"))


def presence(events: DataFrame) -> DataFrame:
    """(patient_id, years): the sorted periods in which an entity has events."""
    return events.groupBy("patient_id").agg(F.array_sort(F.collect_set("year")).alias("years"))


def availability(events: DataFrame, pattern: str) -> DataFrame:
    """(patient_id, n_rows, years, is_pos): each entity's periods up to its first terminal one, and whether it has one.

    One pass and one shuffle: a set of periods and a minimum for each entity.
    """
    own = events.groupBy("patient_id").agg(F.collect_set("year").alias("seen"), F.min(F.when(is_terminal(pattern), F.col("year"))).alias("terminal_year"))
    years = F.array_sort(F.filter("seen", lambda y: F.col("terminal_year").isNull() | (y <= F.col("terminal_year"))))
    return own.select("patient_id", years.alias("years"), F.col("terminal_year").isNotNull().alias("is_pos")).select("patient_id", F.size("years").cast("long").alias("n_rows"), "years", "is_pos").where("n_rows > 0")


def running_rows(available: DataFrame, seed: int = 42) -> DataFrame:
    """``available`` with rn and the running sum cum of n_rows in the shuffled order of each class (seed, negatives seed + 1)."""
    by_class = F.when(F.col("is_pos"), F.lit(seed)).otherwise(F.lit(seed + 1))
    return in_hash_order(available, shuffle_key(by_class), ("is_pos",), "n_rows")


def select_balanced(available: DataFrame, cap_positive: int, cap_negative: int, seed: int = 42) -> DataFrame:
    """As many entities of either class as fit under both row caps; without any that fit, of the smaller class all.

    Running sums grow strictly, so what fits is a prefix of each class. Columns of :func:`running_rows`. An empty class
    raises RuntimeError.
    """
    ranked = materialize(running_rows(available, seed), "ranked")
    fits = F.when(F.col("is_pos"), F.col("cum") <= cap_positive).otherwise(F.col("cum") <= cap_negative)
    found = ranked.agg(F.count_if(F.col("is_pos")), F.count_if(~F.col("is_pos")), F.count_if(F.col("is_pos") & fits), F.count_if(~F.col("is_pos") & fits)).first()
    if not found[0] or not found[1]:
        raise RuntimeError(f"a class is empty: {found[0]} positive and {found[1]} negative entities")
    n = min(found[2], found[3]) or min(found[0], found[1])
    return ranked.where(F.col("rn") <= n)


def class_ratio(rows: DataFrame, label: str = "label") -> DataFrame:
    """(n_pos, n_neg, ratio): negatives per positive, null without positives."""
    own = rows.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return own.withColumn("ratio", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")))


def cap_rows(rows: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows (patient_id, year, ...), drawn in a shuffled order that depends on the keys alone."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("patient_id"), F.lit(":"), F.col("year").cast("string")).cast("binary"))
    return rows.orderBy(key, "patient_id", "year").limit(limit)
