"""Discovery in batches: a source that offers a table tick by tick, and keys that are passed on once, over restarts, too.

The source is a Python data source whose offset is the number of ticks so far. It reads no data itself: a tick is a range of row
numbers, which the executors look up in a stored table; the checkpoint of the stream keeps the offset, and a run that begins
again goes on with the next tick. What has been passed on is state of the stream, dropped when the watermark is past it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators.ordering import numbered
from ..sources.storage import cut

#: Row numbers of one row of the source.
SPAN = 10_000


class Ticks(SimpleDataSourceStreamReader):
    """One tick a read, up to `maxTicks`: `tick` and ranges (`first`, `last`) of row numbers."""

    def __init__(self, options: dict):
        self.total, self.per_tick, self.most = int(options["total"]), int(options["perTick"]), int(options["maxTicks"])

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def rows(self, tick: int) -> list[tuple]:
        lo, hi = tick * self.per_tick + 1, min((tick + 1) * self.per_tick, self.total)
        return [(tick, a, min(a + SPAN - 1, hi)) for a in range(lo, hi + 1, SPAN)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        tick = start["tick"]
        if tick >= self.most or tick * self.per_tick >= self.total:
            return iter([]), start
        return iter(self.rows(tick)), {"tick": tick + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for t in range(start["tick"], end["tick"]) for r in self.rows(t)])


class TickSource(DataSource):
    """`spark.readStream.format("table_ticks")` with options total, perTick and maxTicks."""

    @classmethod
    def name(cls) -> str:
        return "table_ticks"

    def schema(self) -> str:
        return "tick long, first long, last long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return Ticks(self.options)


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their numbers `n`, from 1, stored: what a discovery looks ticks up in."""
    return cut(numbered(rows, order, "n"), "discovery")


def discover(rows: DataFrame, total: int, key: str, per_tick: int, max_ticks: int, seconds: int = 60, remember: str = "7 days") -> DataFrame:
    """A stream of the rows of `in_order`, `per_tick` a tick up to `max_ticks`, each `key` once; adds `tick` and its time `at`.

    Ticks are `seconds` apart in event time, from the first second on (a watermark begins at 0, and what is not after it is late); a key is remembered for as long as `remember`: one that comes again later is
    passed on again. Of rows that share a key within a tick any one is passed on. Null keys are one key.
    """
    spark = rows.sparkSession
    spark.dataSource.register(TickSource)
    ticks = spark.readStream.format("table_ticks").options(total=total, perTick=per_tick, maxTicks=max_ticks).load()
    one = ticks.select("tick", F.explode(F.sequence("first", "last")).alias("n")).join(rows, "n")
    return one.withColumn("at", F.timestamp_seconds((F.col("tick") + 1) * seconds)).withWatermark("at", remember).dropDuplicatesWithinWatermark([key])


def run_ticks(stream: DataFrame, base: str) -> None:
    """Process all ticks that the source offers, and stop; sink and checkpoint lie below `base`, so that a later run goes on there."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/b{batch}")

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def discovered(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All that the runs below `base` passed on."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
