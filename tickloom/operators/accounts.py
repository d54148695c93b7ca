"""Paper accounts: the risk gate as an expression, a broker's netting as one fold, an account of many symbols as a sorted pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """The limits of an account, and what fills cost."""

    cash: float = 100_000.0
    most_size: float = 100_000.0
    daily_loss_pct: float = 5.0
    drawdown_pct: float = 10.0
    margin: float = 0.1
    floor: float = 0.05
    slippage_bps: float = 1.0
    fee: float = 0.001


REASONS = ("size", "daily_loss", "drawdown", "margin", "equity_floor")


def risk_gate(size: Column, price: Column, cash: Column, equity: Column, day_start: Column, day_pnl: Column, drawdown_pct: Column, rules: Rules = Rules()) -> Column:
    """Why an order (`size` below 0 sells) is rejected, by the first rule that it breaks, or null.

    Size; loss of the day against the day's first equity; drawdown; for buys cash of a tenth of the notional; an equity of a
    twentieth of the first cash. A null state breaks no rule.
    """
    lost = F.when(day_start > 0, -day_pnl / day_start * 100)
    return (
        F.when(F.abs(size) > rules.most_size, REASONS[0])
        .when(lost >= rules.daily_loss_pct, REASONS[1])
        .when(drawdown_pct >= rules.drawdown_pct, REASONS[2])
        .when((size > 0) & (cash < size * price * rules.margin), REASONS[3])
        .when(equity < rules.cash * rules.floor, REASONS[4])
    )


def gated_orders(trades: DataFrame, order: list[str], rules: Rules = Rules()) -> DataFrame:
    """The trades with `reason`: each is an order on the account that the strategy's earlier trades leave, day by day of exit."""
    mine, day = Window.partitionBy("strategy_id").orderBy(*order), Window.partitionBy("strategy_id", "day").orderBy(*order)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    t = trades.withColumn("day", F.to_date("exit_ts"))
    t = t.withColumn("cash", rules.cash + F.coalesce(F.sum("pnl").over(before(mine)), F.lit(0.0))).withColumn("day_pnl", F.coalesce(F.sum("pnl").over(before(day)), F.lit(0.0)))
    peak = F.greatest(F.lit(rules.cash), F.max("cash").over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("drawdown_pct", (peak - F.col("cash")) / peak * 100)
    cash = F.col("cash")
    return t.withColumn("reason", risk_gate(F.col("size"), F.col("entry_price"), cash, cash, cash - F.col("day_pnl"), F.col("day_pnl"), F.col("drawdown_pct"), rules))


# -- paper broker ----------------------------------------------------------------------------------


def quote(price: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """Bid, ask, mid and spread in basis points of a price; null without a price."""
    p = F.when(price > 0, price)
    half = p * rules.slippage_bps / 20_000
    bid, ask = p - half, p + half
    return {"bid": bid, "ask": ask, "mid": (bid + ask) / 2, "spread_bps": (ask - bid) / ((bid + ask) / 2) * 10_000}


def broker(orders: DataFrame, by: list[str], at: list[str], size: str = "size", price: str = "price", rules: Rules = Rules()) -> DataFrame:
    """Positions and balance of a paper broker for each value of `by`, after all its orders in the order of `at`.

    Orders fill at once, slippage against them, with a fee on the notional. Adding averages the price; reducing realises, less
    the fee; an order beyond the position reverses it. One fold of a sorted array in generated code and JVM functions.
    Orders without size or price, or of size 0, are rejected.
    """
    ok = F.col(size).isNotNull() & (F.col(size) != 0) & (F.col(price) > 0)
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(at)], F.col(size).cast("double").alias("q"), F.col(price).cast("double").alias("p"))
    grouped = orders.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(ok, row))).alias("orders"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("rejected"))
    zero = F.struct(F.lit(0.0).alias("position"), F.lit(0.0).alias("average"), F.lit(float(rules.cash)).alias("balance"), F.lit(0.0).alias("realised"), F.lit(0.0).alias("last"))

    def step(s: Column, o: Column) -> Column:
        fill = o["p"] * (1 + F.signum(o["q"]) * rules.slippage_bps / 10_000)
        fee = fill * F.abs(o["q"]) * rules.fee
        held, more = F.abs(s["position"]), F.abs(o["q"])
        adding = s["position"] * o["q"] >= 0
        gained = F.least(held, more) * (fill - s["average"]) * F.signum(s["position"]) - fee
        position = s["position"] + o["q"]
        average = F.when(adding, (s["average"] * held + fill * more) / (held + more)).when(more > held, fill).when(position == 0, 0.0).otherwise(s["average"])
        change = F.when(adding, -fee).otherwise(gained)
        return F.struct(position.alias("position"), average.alias("average"), (s["balance"] + change).alias("balance"), (s["realised"] + F.when(adding, 0.0).otherwise(gained)).alias("realised"), o["p"].alias("last"))

    out = grouped.withColumn("s", F.aggregate("orders", zero, step))
    unrealised = (F.col("s.last") - F.col("s.average")) * F.col("s.position")
    side = F.when(F.col("s.position") > 0, "long").when(F.col("s.position") < 0, "short").otherwise("flat")
    return out.select(*by, F.size("orders").alias("fills"), "rejected", side.alias("side"), "s.position", "s.average", "s.balance", "s.realised", unrealised.alias("unrealised"), (F.col("s.balance") + unrealised).alias("equity"))


# -- account of many symbols -----------------------------------------------------------------------

ACCOUNT = "strategy_id long, fills long, rejected long, cash double, equity double, realised double, fees double, open long, drawdown_pct double"


def run_account(orders: list[tuple], rules: Rules = Rules()) -> tuple:
    """(fills, rejected, cash, equity, realised, fees, open positions, drawdown) after orders (day, symbol, size, price) in time.

    An order moves its symbol's price first. Equity is cash and the value of all positions at their last prices.
    """
    cash = equity = peak = day_start = rules.cash
    prices: dict[str, float] = {}
    held: dict[str, list[float]] = {}
    today, day_pnl, realised, fees, fills, rejected, drawdown, worst = None, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0
    for day, symbol, size, price in orders:
        prices[symbol] = price
        equity = cash + sum(q * prices[s] for s, (q, _) in held.items())
        peak = max(peak, equity)
        drawdown = (peak - equity) / peak * 100
        worst = max(worst, drawdown)
        if day != today:
            today, day_pnl, day_start = day, 0.0, equity
        broken = (
            abs(size) > rules.most_size, day_start > 0 and -day_pnl / day_start * 100 >= rules.daily_loss_pct, drawdown >= rules.drawdown_pct,
            size > 0 and cash < size * price * rules.margin, equity < rules.cash * rules.floor,
        )
        if any(broken):
            rejected += 1
            continue
        fill = price * (1 + (rules.slippage_bps if size > 0 else -rules.slippage_bps) / 10_000)
        fee = abs(size) * fill * rules.fee
        q, average = held.get(symbol, (0.0, 0.0))
        if q * size >= 0:
            average = (average * abs(q) + fill * abs(size)) / (abs(q) + abs(size)) if q or size else 0.0
        else:
            gain = min(abs(q), abs(size)) * (fill - average) * (1 if q > 0 else -1) - fee
            realised, day_pnl = realised + gain, day_pnl + gain
            average = fill if abs(size) > abs(q) else average
        q += size
        held[symbol] = [q, average] if abs(q) > 1e-9 else [0.0, 0.0]
        cash, fees, fills = cash - size * fill - fee, fees + fee, fills + 1
    equity = cash + sum(q * prices[s] for s, (q, _) in held.items())
    return fills, rejected, cash, equity, realised, fees, sum(1 for q, _ in held.values() if q), worst


def _accounts(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, *run_account([(o["day"], o["symbol"], o["size"], o["price"]) for o in orders], rules)) for key, orders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            names, kinds = zip(*(x.split() for x in ACCOUNT.split(", ")), strict=True)
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.record_batch([pa.array(c, pa.int64() if k == "long" else pa.float64()) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    return run


def paper_account(trades: DataFrame, order: list[str], rules: Rules = Rules()) -> DataFrame:
    """The account of every strategy: entries and exits of its trades are market orders, in time; one row, one pass, for each."""
    legs = F.explode(F.array(
        F.struct(F.col("entry_ts").alias("at"), F.lit(0).alias("leg"), F.col("size").alias("q"), F.col("entry_price").alias("p")),
        F.struct(F.col("exit_ts").alias("at"), F.lit(1).alias("leg"), (-F.col("size")).alias("q"), F.col("exit_price").alias("p")),
    ))
    o = trades.select("strategy_id", "symbol", *[c for c in order if c not in ("exit_ts", "size")], legs.alias("o"))
    row = F.struct(F.col("o.at").alias("at"), F.col("o.leg").alias("leg"), *[c for c in order if c not in ("exit_ts", "size")], "symbol", F.col("o.q").alias("size"), F.col("o.p").alias("price"))
    sorted_ = o.groupBy("strategy_id").agg(F.array_sort(F.collect_list(row)).alias("orders"))
    slim = sorted_.select("strategy_id", F.transform("orders", lambda x: F.struct(F.unix_date(x["at"].cast("date")).alias("day"), x["symbol"].alias("symbol"), x["size"].alias("size"), x["price"].alias("price"))).alias("orders"))
    return slim.mapInArrow(_accounts(rules), ACCOUNT)
