"""The end of a trading day as an event-time timer: one row a symbol and day, when no tick of it can come any more.

A symbol's state is a map of its open days. The first tick of a day sets a timer for the day's end; it fires when the watermark
is past it, and then the day's row leaves and its state goes. A tick that comes after the watermark has passed its time is late: the
stream drops it, and the row that has left stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

DAY_MS = 86_400_000
DAYS = StructType([
    StructField("symbol", StringType()), StructField("day", TimestampType()), StructField("ticks", LongType()), StructField("open", DoubleType()), StructField("high", DoubleType()),
    StructField("low", DoubleType()), StructField("close", DoubleType()), StructField("turnover", DoubleType()), StructField("alert", StringType()),
])
_KEY = StructType([StructField("day", LongType())])
_OPEN = StructType([StructField("ticks", LongType()), *[StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "turnover")], *[StructField(c, LongType()) for c in ("first_us", "first_id", "last_us", "last_id")]])


def alert_of(ticks: int, open_: float, high: float, low: float, close: float, fewest: int, fall: float) -> str:
    """What a closed day calls for: `fall` if it lost more than a share, `quiet` if it had too few ticks, else nothing; the worst first."""
    if open_ > 0 and close / open_ - 1 < -fall:
        return "fall"
    return "quiet" if ticks < fewest else ""


class DayEnd(StatefulProcessor):
    """Folds ticks (ts, price, tick_id) of a symbol into its open days; a timer closes each."""

    def __init__(self, fewest: int, fall: float):
        self.fewest, self.fall = fewest, fall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.days = handle, handle.getMapState("days", _KEY, _OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.assign(us=pdf["ts"].astype("datetime64[us]").astype("int64"))
            for day, g in pdf.sort_values(["us", "tick_id"]).groupby(pdf["us"] // (DAY_MS * 1000)):
                first, last = g.iloc[0], g.iloc[-1]
                new = (len(g), float(first["price"]), float(g["price"].max()), float(g["price"].min()), float(last["price"]), float(g["price"].sum()), int(first["us"]), int(first["tick_id"]), int(last["us"]), int(last["tick_id"]))
                at = (int(day),)
                if self.days.containsKey(at):
                    old = tuple(self.days.getValue(at))
                    begin, end = min(old, new, key=lambda x: x[6:8]), max(old, new, key=lambda x: x[8:10])
                    new = (old[0] + new[0], begin[1], max(old[2], new[2]), min(old[3], new[3]), end[4], old[5] + new[5], *begin[6:8], *end[8:10])
                else:
                    self.handle.registerTimer((int(day) + 1) * DAY_MS)
                self.days.updateValue(at, new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        n, open_, high, low, close, turnover, *_ = tuple(self.days.getValue((day,)))
        self.days.removeKey((day,))
        row = (key[0], pd.Timestamp(day * DAY_MS, unit="ms"), n, open_, high, low, close, turnover, alert_of(n, open_, high, low, close, self.fewest, self.fall))
        yield pd.DataFrame([row], columns=[f.name for f in DAYS.fields])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams with timers keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def close_days(ticks: DataFrame, late: str = "1 hour", fewest: int = 5, fall: float = 0.5) -> DataFrame:
    """A stream of closed days from a stream of ticks (symbol, ts, price, tick_id): append mode, one row a symbol and day, once.

    Days are civil days in UTC and close when the watermark, the latest time seen less `late`, is past their end. Ticks
    without a symbol, a time or a price are left out.
    """
    known = ticks.select("symbol", "ts", "price", "tick_id").na.drop(subset=["symbol", "ts", "price"]).withWatermark("ts", late)
    return known.groupBy("symbol").transformWithStateInPandas(statefulProcessor=DayEnd(fewest, fall), outputStructType=DAYS, outputMode="append", timeMode="EventTime")
