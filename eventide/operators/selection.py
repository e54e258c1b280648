"""Feature selection: by frequency, then by the gain of boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BoostingConfig, CohortConfig
from ..sources.events import is_terminal
from .boosting import boosted_splits


def event_frequency(events: DataFrame, config: CohortConfig) -> DataFrame:
    """(event, n): in how many distinct entity-periods a feature event occurs; terminal events are no features."""
    own = events.where(F.upper("event") != config.row_terminal.upper())
    if config.exclude_terminal_like_features:
        own = own.where(~is_terminal(config.entity_terminal))
    return own.select("patient_id", "year", "event").distinct().groupBy("event").agg(F.count("*").alias("n"))


def most_frequent(events: DataFrame, config: CohortConfig, k: int) -> DataFrame:
    """The ``k`` most frequent feature events, ties by event."""
    return event_frequency(events, config).orderBy(F.desc("n"), F.asc("event")).limit(k)


def with_terminal(values: list[str], terminal: str) -> list[str]:
    return list(dict.fromkeys([*values, terminal]))


def gain_ranking(events: DataFrame, values: list[str], terminal: str, config: BoostingConfig) -> DataFrame:
    """(event, gain) of every candidate: what the splits on it gain in boosted trees, 0 if there are none.

    Rows are entity-periods with a candidate or the terminal event, which is their label; classes are weighted by their
    ratio. Without a positive row it raises RuntimeError.
    """
    gains = boosted_splits(events, values, terminal, config).groupBy("event").agg(F.sum("gain").alias("gain"))
    names = events.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "event string")
    return names.join(gains, "event", "left").select("event", F.coalesce("gain", F.lit(0.0)).alias("gain"))


def top_events(events: DataFrame, config: CohortConfig, boosting: BoostingConfig | None = None) -> list[str]:
    """The ordered features: the most frequent ones, or with ``boosting`` those of most gain among the candidates."""
    k = config.candidates if boosting else config.top_k
    found = [r["event"] for r in most_frequent(events, config, k).collect()]  # at most k names
    if not boosting:
        return found
    ranked = gain_ranking(events, found, config.row_terminal, boosting)
    return [r["event"] for r in ranked.orderBy(F.desc("gain"), F.asc("event")).limit(config.top_k).collect()]
