"""Streams: buckets, and first terminal events by keyed state."""

import datetime as dt

import pytest

from eventide.streaming import events as streams

SCHEMA = "patient_id string, date timestamp_ntz, year int, event string"


@pytest.fixture
def stream(spark, tmp_path):
    """A function that adds rows (patient, day, hour, event) to the stream's folder and returns what has been given by then."""
    before = spark.conf.get(streams.STATE_STORE[0], None)
    spark.conf.set(*streams.STATE_STORE)
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def add(*rows, keep_days=20):
        made = [(p, dt.datetime(2024, 1, 1, hour, 0, 0, 5000) + dt.timedelta(days=day), 2024, e) for p, day, hour, e in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        live = streams.first_terminal(spark.readStream.schema(SCHEMA).parquet(log), "(?i)DEATH", keep_days=keep_days)
        q = live.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["patient_id"], (r["terminal_date"] - dt.datetime(2024, 1, 1)).days, r["terminal_date"].hour) for r in spark.read.schema(live.schema).parquet(out).collect())

    yield add
    spark.conf.unset(streams.STATE_STORE[0]) if before is None else spark.conf.set(streams.STATE_STORE[0], before)


def test_first_terminal_events(stream):
    assert stream(("p", 3, 10, "Death"), ("p", 5, 1, "DEATH"), ("q", 5, 0, "DEATH X"), ("r", 1, 0, "fever"), ("s", 9, 0, None)) == [("p", 3, 10)]
    # an earlier one in time counts, one behind the watermark doesn't, nothing is given twice
    assert stream(("q", 4, 12, "DEATH"), ("r", 1, 0, "DEATH"), ("p", 9, 0, "DEATH")) == [("p", 3, 10), ("q", 4, 12)]
    assert stream(("p", 12, 0, "DEATH"), ("t", 12, 1, "DEATH")) == [("p", 3, 10), ("q", 4, 12)]
    # state goes: after it, p's next terminal event is a first one again
    assert stream(("t", 40, 0, "DEATH")) == [("p", 3, 10), ("q", 4, 12), ("t", 12, 1)]
    assert ("p", 50, 0) in stream(("p", 50, 0, "DEATH"), ("u", 60, 0, "DEATH"))


def test_no_rows(stream):
    assert stream() == []
