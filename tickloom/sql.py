"""DuckDB twins of the views, as common table expressions for the SQL of queries."""

from __future__ import annotations

from .sources.views import MUTATIONS, ORIGINS, SYMBOLS, TIMEFRAMES


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ORDER = "exit_ts, order_key, line, variant_key, entry_price, size"

VIEWS = {
    "ticks": "SELECT event_id AS tick_id, event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS volume FROM events",
    "bars": """SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY ts, tick_id) AS close, sum(volume) AS volume FROM ticks GROUP BY ALL""",
    "strategies": f"""SELECT p_partkey AS strategy_id, p_name AS name, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent_id,
      {_list(MUTATIONS)}[p_partkey % 5 + 1] AS mutation_type, p_brand AS hypothesis_id, CAST(CASE WHEN p_partkey > 0 THEN length(bin(p_partkey)) ELSE 0 END AS BIGINT) AS level,
      {_list(ORIGINS)}[p_partkey % 3 + 1] AS origin, CASE WHEN p_partkey % 7 = 0 THEN 'promoted' WHEN p_partkey % 11 = 0 THEN 'retired' ELSE 'active' END AS status, p_retailprice AS cost FROM part""",
    "trades": f"""SELECT *, (exit_price - entry_price) * size AS pnl, 100 * sign(size) * (exit_price / entry_price - 1) AS return_pct, date_diff('day', entry_ts, exit_ts) AS days FROM (
      SELECT l_partkey AS strategy_id, l_suppkey AS variant_key, l_orderkey AS order_key, l_linenumber AS line, {_list(SYMBOLS)}[l_linenumber] AS symbol,
      least(o_orderdate, l_shipdate) AS entry_ts, greatest(o_orderdate, l_shipdate) AS exit_ts, l_quantity * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS size,
      l_extendedprice / l_quantity AS entry_price, l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS exit_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "returns": f"SELECT strategy_id, row_number() OVER (PARTITION BY strategy_id ORDER BY {ORDER}) AS t, return_pct / 100 AS r FROM trades",
    "results": f"""SELECT strategy_id, 'strategy_' || strategy_id AS strategy_name, CASE WHEN strategy_id % 4 <> 0 THEN 'variant_' || lpad(CAST(strategy_id % 15 + 1 AS VARCHAR), 2, '0') END AS variant_id,
      symbol, {_list(TIMEFRAMES)}[strategy_id % 4 + 1] AS timeframe, start_ts, end_ts, bars_tested, 100000.0::DOUBLE AS initial_cash, 100000.0 * (1 + total_return_pct / 100) AS final_value,
      total_return_pct, round(sharpe_raw * sqrt(252.0::DOUBLE) + 3e-8, 6) AS sharpe_ratio, max_drawdown_pct, total_trades, win_rate, profit_factor FROM (
      SELECT strategy_id, symbol, count(*) AS total_trades, round(sum(pnl) / 100000.0 * 100 + 3e-11, 9) AS total_return_pct, round(CASE WHEN stddev_samp(return_pct) > 1e-9 THEN avg(return_pct) / stddev_samp(return_pct) END + 3e-11, 9) AS sharpe_raw,
      round(max((peak - equity) / peak * 100) + 3e-11, 9) AS max_drawdown_pct, round(100.0::DOUBLE * count(*) FILTER (pnl > 0) / count(*) + 3e-11, 9) AS win_rate,
      round(sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0) + 3e-11, 9) AS profit_factor, CAST(sum(days) AS BIGINT) AS bars_tested, min(entry_ts) AS start_ts, max(exit_ts) AS end_ts FROM (
      SELECT *, greatest(100000.0, max(equity) OVER w) AS peak FROM (SELECT *, 100000.0 + sum(pnl) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY strategy_id, symbol ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING))
      WINDOW w AS (PARTITION BY strategy_id, symbol ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)) GROUP BY ALL)""",
}
NEEDS = {"bars": ["ticks"], "returns": ["trades"], "results": ["trades"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """`body` below the views it names (space-separated) and those they need; `body` may begin with `, x AS (...)`."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body
