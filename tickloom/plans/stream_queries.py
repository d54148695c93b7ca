"""Queries of streams with restarts and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_folder
from ..sources.views import table
from ..sql import with_views
from ..streaming import days, discovery, live
from .common import rounded
from .results_queries import r

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql) if views else sql


def _discovered(s: SparkSession, d: str) -> DataFrame:
    """Pages in 8 ticks, each host once; the stream is stopped after the third tick and goes on from its checkpoint."""
    pages = table(s, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host"))
    rows = discovery.in_order(pages, ["page_id", "host"])
    total = rows.count()
    per_tick, base = max(1, -(-total // 8)), new_folder(s, "discovery")
    for ticks in (3, 8):
        stream = discovery.discover(rows, total, "host", per_tick, ticks)
        discovery.run_ticks(stream, base)
    return discovery.discovered(s, base, stream.schema).select("host", "tick")


add("R14_discovery_batches", _discovered, "", "WITH p AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, row_number() OVER (ORDER BY page_id, host) AS n, count(*) OVER () AS total FROM pages) SELECT host, min((n - 1) // greatest(1, CAST(ceil(total / 8) AS BIGINT))) AS tick FROM p GROUP BY host")


def _days(s: SparkSession, d: str) -> DataFrame:
    with days.rocksdb(s):
        return live.run_available(days.close_days(live.tick_stream(s, d)), "append").drop("batch")


add(
    "R8_day_end",
    _days,
    "ticks",
    f"""SELECT symbol, day, count(*) AS ticks, {r('first(price ORDER BY ts, tick_id) AS open', 'max(price) AS high', 'min(price) AS low', 'last(price ORDER BY ts, tick_id) AS close', 'sum(price) AS turnover')},
  CASE WHEN first(price ORDER BY ts, tick_id) > 0 AND last(price ORDER BY ts, tick_id) / first(price ORDER BY ts, tick_id) - 1 < -0.5 THEN 'fall' WHEN count(*) < 5 THEN 'quiet' ELSE '' END AS alert
FROM (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, max(ts) OVER () AS latest FROM ticks) WHERE day + INTERVAL 1 DAY <= latest - INTERVAL 1 HOUR GROUP BY symbol, day""",
)
