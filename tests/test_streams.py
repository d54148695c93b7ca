"""Streams over restarts: every key once, every day once, late ticks nowhere."""

import random

import pytest
from pyspark.sql import functions as F


def test_discovery_goes_on_where_it_was_stopped(spark, tmp_path):
    from tickloom.streaming import discovery

    rng = random.Random(1)
    rows = [(i, rng.choice([None, *[f"k{j}" for j in range(25)]])) for i in range(60)]
    df = discovery.in_order(spark.createDataFrame(rows, "id long, key string"), ["id"])
    base, seen = f"file://{tmp_path}", []
    for ticks in (1, 3, 3, 6):
        stream = discovery.discover(df, 60, "key", 10, ticks)
        discovery.run_ticks(stream, base)
        seen.append([(r["key"], r["tick"]) for r in discovery.discovered(spark, base, stream.schema).collect()])
    first = {}
    for i, k in rows:
        first.setdefault(k, i // 10)
    for found, ticks in zip(seen, (1, 3, 3, 6), strict=True):
        assert len(found) == len({k for k, _ in found}) and dict(found) == {k: t for k, t in first.items() if t < ticks}


def test_the_source_repeats_a_range_of_ticks():
    from tickloom.streaming.discovery import SPAN, Ticks

    t = Ticks({"total": "25000", "perTick": "12000", "maxTicks": "5"})
    at, rows = t.initialOffset(), []
    while True:
        found, to = t.read(at)
        found = list(found)
        if to == at:
            break
        assert found == list(t.readBetweenOffsets(at, to))
        rows, at = rows + found, to
    assert at == {"tick": 3} and rows == list(t.readBetweenOffsets({"tick": 0}, at)) and all(b - a < SPAN for _, a, b in rows)
    assert sorted(n for _, a, b in rows for n in range(a, b + 1)) == list(range(1, 25001))
    assert list(Ticks({"total": "0", "perTick": "5", "maxTicks": "5"}).read({"tick": 0})[0]) == []


def test_days_close_once_and_late_ticks_are_dropped(spark, tmp_path):
    from tickloom.streaming import days

    hour = 3600
    batches = [
        [("a", 1 * hour, 10.0, 1), ("a", 5 * hour, 4.0, 2), ("b", 2 * hour, 1.0, 3), (None, hour, 1.0, 4), ("a", None, 1.0, 5), ("a", hour, None, 6)],
        [("a", 23 * hour, 4.0, 7), ("a", 23 * hour, 5.0, 8), ("a", 26 * hour, 7.0, 9), ("b", 3 * hour, 2.0, 10)],  # the last one is late: the watermark has passed 4 h
        [("a", 30 * hour, 8.0, 11), ("a", 2 * hour, 99.0, 12)],  # the last one is late: the watermark has passed 25 h
        [("b", 60 * hour, 3.0, 13)],
        [("a", 31 * hour, 99.0, 14), ("c", 61 * hour, 1.0, 15)],  # and so is the first one here
    ]
    kind = "symbol string, at long, price double, tick_id long"
    source, base = f"{tmp_path}/in", f"{tmp_path}/state"
    out = []

    def sink(df, batch):
        out.extend((r["symbol"], int(r["day"].timestamp()), *tuple(r)[2:]) for r in df.collect())

    with days.rocksdb(spark):
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(kind).parquet(source).select("symbol", F.timestamp_seconds("at").alias("ts"), "price", "tick_id")
            q = days.close_days(stream, "1 hour", fewest=3, fall=0.5).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", base).trigger(availableNow=True).start()
            q.awaitTermination()
    assert sorted(out) == [("a", 0, 4, 10.0, 10.0, 4.0, 5.0, 23.0, ""), ("a", 86400, 2, 7.0, 8.0, 7.0, 8.0, 15.0, "quiet"), ("b", 0, 1, 1.0, 1.0, 1.0, 1.0, 1.0, "quiet")]


@pytest.mark.parametrize(("day", "alert"), [((9, 10.0, 10.0, 4.0, 4.0), "fall"), ((2, 10.0, 10.0, 4.0, 4.0), "fall"), ((2, 10.0, 10.0, 9.0, 9.0), "quiet"), ((9, 10.0, 11.0, 1.0, 9.0), ""), ((9, 0.0, 0.0, 0.0, 0.0), "")])
def test_alerts(day, alert):
    from tickloom.streaming.days import alert_of

    assert alert_of(*day, fewest=5, fall=0.5) == alert
