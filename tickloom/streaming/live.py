"""Streams of ticks: bars with watermarks, online drift with state, paper fills; each has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.storage import shared_folder


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream of ticks: symbol, ts, price, tick_id."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling bars by event time; ticks later than the watermark are dropped."""
    at = F.struct("ts", "tick_id")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    return g.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("ticks")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "ticks")


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Process what is there and return all output rows with the micro-batch that made them; sink and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/b{batch}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", True).parquet(f"{base}/out")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return updates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "batch")


DRIFT = "symbol string, n long, mean double, page_hinkley double, cusum_up double, cusum_down double"
STATE = "n long, total double, ph_sum double, ph_min double, up double, down double"


def _advance(state: tuple, price: float, reference: tuple[float, float]) -> tuple:
    n, total, ph, least, up, down = state
    n, total = n + 1, total + price
    ph += price - total / n - 0.005
    least = min(least, ph) if n > 1 else ph
    z = (price - reference[0]) / reference[1]
    return n, total, ph, least, max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)


def stream_drift(ticks: DataFrame, mean: float, sd: float) -> DataFrame:
    """Page-Hinkley and CUSUM statistics by symbol, kept in the state of the stream."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "tick_id"])
        for price in rows["price"].tolist():
            now = _advance(now, price, (mean, sd))
        state.update(now)
        yield pd.DataFrame([(key[0], now[0], now[1] / now[0], now[2] - now[3], now[4], now[5])], columns=[c.split()[0] for c in DRIFT.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(run, DRIFT, STATE, "update", GroupStateTimeout.NoTimeout)


ACCOUNT = "symbol string, fills long, position double, cash double, equity double, last_price double"


def stream_paper(ticks: DataFrame, low: float, high: float) -> DataFrame:
    """A shadow account by symbol: buys a unit below `low`, sells it above `high`, marked to the last price; state survives micro-batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fills, position, cash, price = state.get if state.exists else (0, 0.0, 1000.0, 0.0)
        for price in pd.concat(list(frames)).sort_values(["ts", "tick_id"])["price"].tolist():
            if position == 0 and price < low:
                fills, position, cash = fills + 1, 1.0, cash - price
            elif position == 1 and price > high:
                fills, position, cash = fills + 1, 0.0, cash + price
        state.update((fills, position, cash, price))
        yield pd.DataFrame([(key[0], fills, position, cash, cash + position * price, price)], columns=[c.split()[0] for c in ACCOUNT.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(run, ACCOUNT, "fills long, position double, cash double, price double", "update", GroupStateTimeout.NoTimeout)


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of activity by symbol: an extension beyond fixed windows."""
    g = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("turnover"))
    return g.select("symbol", F.col("w.start").alias("start"), "ticks", "turnover")
