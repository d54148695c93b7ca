"""Closed forms against plain loops, kernels against definitions, sources against literal files."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F


def walk(spark, n=120, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    rows = [("A", datetime(2023, 1, 1) + timedelta(hours=i), float(c - 0.2), float(c + 0.5), float(c - 0.5), float(c), 100.0) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_smoothed_regime_equals_loop(spark):
    from tickloom.operators.regimes import smoothed

    rng = np.random.default_rng(3)
    raw = [str(x) for x in rng.choice(["BULL", "BEAR", "RANGING"], 200, p=[0.5, 0.3, 0.2])]
    df = spark.createDataFrame([("A", datetime(2023, 1, 1) + timedelta(hours=i), r) for i, r in enumerate(raw)], "symbol string, ts timestamp, raw_regime string")
    got = [r["regime"] for r in smoothed(df).orderBy("ts").collect()]
    want, current, run = [], "UNKNOWN", 0
    for i, r in enumerate(raw):
        run = run + 1 if i and raw[i - 1] == r else 1
        current = r if run >= 3 else current
        want.append(current)
    assert got == want


def test_recursive_mean_equals_loop(spark):
    from tickloom.operators.indicators import recursive_mean

    bars = walk(spark, 60)
    got = [r["e"] for r in recursive_mean(bars, {"e": ("close", 0.2)}).orderBy("ts").collect()]
    y, want = None, []
    for r in bars.orderBy("ts").collect():
        y = r["close"] if y is None else y + 0.2 * (r["close"] - y)
        want.append(y)
    assert np.allclose(got, want)


def test_online_statistics_equal_loops(spark):
    from tickloom.functions.statistics import cusum, page_hinkley

    z = np.random.default_rng(5).normal(0, 1, 300)
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(z)], "symbol string, t long, z double")
    got = cusum(df, "symbol", "t", "z").orderBy("t").toPandas()
    up = down = 0.0
    for i, x in enumerate(z):
        up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
        assert math.isclose(got["cusum_up"][i], up, abs_tol=1e-9) and math.isclose(got["cusum_down"][i], down, abs_tol=1e-9)
    ph = page_hinkley(df, "symbol", "t", "z").orderBy("t").toPandas()["page_hinkley"]
    s, least, total = 0.0, math.inf, 0.0
    for i, x in enumerate(z):
        total += x
        s += x - total / (i + 1) - 0.005
        least = min(least, s)
        assert math.isclose(ph[i], s - least, abs_tol=1e-9)


def test_pbo_equals_definition(spark):
    from tickloom.functions.statistics import pbo

    rng = np.random.default_rng(7)
    r = rng.normal(0.0005, 0.01, (80, 5))
    df = spark.createDataFrame([(s, t + 1, float(r[t, s])) for s in range(5) for t in range(80)], "strategy_id long, t long, r double")
    got = {x["combo"]: x for x in pbo(df, 4).collect()}
    blocks = np.array_split(np.arange(80), 4)
    sharpe = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252)
    for i, c in enumerate(itertools.combinations(range(4), 2)):
        inside, outside = np.concatenate([blocks[k] for k in c]), np.concatenate([blocks[k] for k in range(4) if k not in c])
        a, b = [sharpe(r[inside, s]) for s in range(5)], [sharpe(r[outside, s]) for s in range(5)]
        best = int(np.argmax(a))
        p = min(max((1 + sum(x < b[best] for x in b)) / 5, 1e-6), 1 - 1e-6)
        assert got[i]["strategy_id"] == best and math.isclose(got[i]["logit"], math.log(p / (1 - p)), abs_tol=1e-9)


def test_more_trials_deflate_more(spark):
    from tickloom.functions.statistics import sharpe_tests

    r = np.random.default_rng(9).normal(0.001, 0.01, 300)
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(r)], "strategy_id long, t long, r double")
    few, many = (sharpe_tests(df, n).first()["dsr_p"] for n in (10, 1000))
    assert few < many


def test_exit_rules():
    from tickloom.operators.simulate import RULES, walk

    bar = lambda i, o, h, low, c, s=0: (i, o, h, low, c, s)
    rows = [bar(0, 100, 100, 100, 100, 1), bar(1, 100, 101, 99.5, 100), bar(2, 100, 105, 99.9, 104)]
    ((_, at, entry, price, units, bars, why),) = walk(rows, RULES["bracket"])
    assert (at, entry, price, units, bars, why) == (2, 100, 104.0, 1.0, 2, "target")
    rows[2] = bar(2, 97, 105, 90, 104)
    assert walk(rows, RULES["bracket"])[0][3:] == (97, 1.0, 2, "stop")
    parts = walk([bar(0, 100, 100, 100, 100, 1), bar(1, 100, 102.5, 99.9, 102), bar(2, 102, 106, 101.9, 105)], RULES["partial"])
    assert [(p[3], p[4]) for p in parts] == [(102.0, 0.5), (104.0, 0.5)]
    assert walk([], RULES["hold"]) == []


def test_paper_broker(spark):
    """Buys, closes, shorts, reversals and rejects of a broker without slippage and with it."""
    from tickloom.operators.accounts import Rules, broker, quote

    orders = [("a", 1, 1.0, 50_000.0), ("a", 2, -1.0, 55_000.0), ("b", 1, -10.0, 3000.0), ("c", 1, 10.0, 100.0), ("c", 2, 10.0, 110.0), ("c", 3, -30.0, 120.0), ("d", 1, 0.0, 5.0), ("d", 2, 1.0, None)]
    df = spark.createDataFrame(orders, "symbol string, n long, size double, price double")
    got = {r["symbol"]: r for r in broker(df, ["symbol"], ["n"], rules=Rules(slippage_bps=0.0)).collect()}
    assert (got["a"]["side"], got["a"]["position"]) == ("flat", 0) and math.isclose(got["a"]["realised"], 5000 - 55) and got["a"]["balance"] > 100_000
    assert (got["b"]["side"], got["b"]["position"], got["b"]["average"]) == ("short", -10, 3000)
    assert (got["c"]["side"], got["c"]["position"], got["c"]["average"]) == ("short", -10, 120) and math.isclose(got["c"]["realised"], 20 * 15 - 30 * 120 * 0.001)
    assert (got["d"]["fills"], got["d"]["rejected"], got["d"]["side"], got["d"]["equity"]) == (0, 2, "flat", 100_000)
    slipped = {r["symbol"]: r for r in broker(df, ["symbol"], ["n"]).collect()}
    assert math.isclose(slipped["b"]["average"], 3000 * (1 - 1e-4)) and slipped["a"]["realised"] < got["a"]["realised"]
    q = spark.createDataFrame([(50_000.0,), (0.0,), (None,)], "p double").select(*[c.alias(n) for n, c in quote(F.col("p")).items()]).collect()
    assert q[0]["bid"] < q[0]["mid"] < q[0]["ask"] and math.isclose(q[0]["spread_bps"], 1.0, abs_tol=1e-9) and q[1]["mid"] is None and q[2]["bid"] is None


def test_risk_gate_and_account(spark):
    """Each rule alone rejects; the account's sums hold whatever the orders."""
    from tickloom.operators.accounts import REASONS, Rules, risk_gate, run_account

    rows = [(1.0, 10.0, 1e5, 1e5, 1e5, 0.0, 0.0), (2e5, 0.1, 1e5, 1e5, 1e5, 0.0, 0.0), (1.0, 10.0, 1e5, 1e5, 1e5, -5000.0, 0.0), (1.0, 10.0, 1e5, 1e5, 1e5, 0.0, 10.0), (1000.0, 1001.0, 1e5, 1e5, 1e5, 0.0, 0.0), (-1000.0, 1001.0, 1e5, 1e5, 1e5, 0.0, 0.0), (-1.0, 10.0, 1e5, 4999.0, 1e5, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, size double, price double, cash double, equity double, start double, pnl double, dd double")
    got = [r[0] for r in df.orderBy("i").select(risk_gate(*[F.col(c) for c in ("size", "price", "cash", "equity", "start", "pnl", "dd")])).collect()]
    assert got == [None, REASONS[0], REASONS[1], REASONS[2], REASONS[3], None, REASONS[4]]
    rng = np.random.default_rng(11)
    free = Rules(most_size=1e12, daily_loss_pct=1e9, drawdown_pct=1e9, margin=0.0, floor=-1e9)
    orders = [(i // 7, str(rng.choice(["x", "y"])), float(rng.integers(-9, 10)) or 1.0, float(rng.uniform(5, 15))) for i in range(200)]
    fills, rejected, cash, equity, realised, fees, open_, _ = run_account(orders, free)
    want_cash, held, last = 100_000.0, {"x": 0.0, "y": 0.0}, {}
    for _, s, q, p in orders:
        fill = p * (1.0001 if q > 0 else 0.9999)
        want_cash -= q * fill + abs(q) * fill * 0.001
        held[s] += q
        last[s] = p
    assert (fills, rejected) == (200, 0) and math.isclose(cash, want_cash, rel_tol=1e-12) and math.isclose(equity, want_cash + sum(held[s] * last[s] for s in held), rel_tol=1e-9)
    assert run_account([(0, "x", 1000.0, 1001.0)])[:3] == (0, 1, 100_000.0) and run_account([])[:3] == (0, 0, 100_000.0)
    lost = run_account([(0, "x", 500.0, 100.0), (0, "x", -500.0, 85.0), (0, "x", 1.0, 85.0), (1, "x", 1.0, 85.0)])
    assert lost[0] == 3 and lost[1] == 1  # the day's loss stops the third order, not the next day's


def test_hooks_and_stored_steps(spark, tmp_path):
    from tickloom.operators import hooks
    from tickloom.sources import files

    bars = walk(spark, 80)
    assert hooks.run_callbacks(bars, "symbol", {}).count() == 0
    with pytest.raises(KeyError):
        hooks.run_registered(bars, "unknown")
    with pytest.raises(ValueError):
        hooks.register("above_mean", lambda: F.lit(True), lambda: F.lit(False))
    made = []
    first = lambda: spark.createDataFrame([(1, 0)], "k long, v long")
    step = lambda df, i: (made.append(i), df.withColumn("v", F.col("v") + i))[1]
    assert files.resumable(spark, str(tmp_path / "s"), 2, first, step).first()["v"] == 3
    assert files.resumable(spark, str(tmp_path / "s"), 4, first, step).first()["v"] == 10 and made == [1, 2, 3, 4]
    assert files.cached(spark, str(tmp_path / "c"), first).count() == 1 and files.clear_cache(spark, str(tmp_path / "c")) and not files.clear_cache(spark, str(tmp_path / "c"))


def test_pareto_greedy_and_weights(spark):
    from tickloom.operators import selection as sel

    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 2.0, 2.0), (3, 4.0, 3.0), (4, 3.0, 1.0), (5, None, 0.0)], "k long, a double, b double")
    assert sorted(r["k"] for r in sel.pareto_front(df, ["a"], ["b"], "k").collect()) == [1, 3, 4]
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (4, 40))
    series = [base[0], base[0] + 0.1 * rng.normal(0, 1, 40), base[1], base[2], base[1] * 2, base[3], base[3]]
    profiles = spark.createDataFrame([(i, [float(v) for v in x], [i]) for i, x in enumerate(series)], "strategy_id long, r array<double>, days array<int>")
    scored = spark.createDataFrame([(i, 1 - i / 10) for i in range(7)], "strategy_id long, score double")
    for block in (256, 2, 1):
        assert [r["strategy_id"] for r in sel.greedy(scored, profiles, 0.5, least=1, block=block).orderBy("pick").collect()] == [0, 2, 3, 5]
    assert [r["strategy_id"] for r in sel.greedy(scored, profiles, 0.5, most=2, least=1).orderBy("pick").collect()] == [0, 2]
    assert [r["strategy_id"] for r in sel.greedy(scored, profiles, 0.5, least=6).orderBy("pick").collect()] == [0, 2, 3, 5, 1, 4]
    pts = rng.integers(0, 6, (200, 3)).astype(float)
    three = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, a double, b double, c double")
    o = pts * [1, 1, -1]
    want = [i for i in range(200) if not any((o[j] >= o[i]).all() and (o[j] > o[i]).any() for j in range(200))]
    assert sorted(r["k"] for r in sel.pareto_front(three, ["a", "b"], ["c"], "k", block=7).collect()) == want
    cov = np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.01], [0.0, 0.01, 0.01]])
    for m in sel.METHODS:
        w = sel.weights(cov, np.array([0.1, 0.12, 0.05]), m)
        assert math.isclose(w.sum(), 1, abs_tol=1e-9) and (w >= -1e-12).all()
    risk = (lambda w: w * (cov @ w))(sel.weights(cov, np.zeros(3), "risk_parity"))
    assert np.allclose(risk / risk.sum(), 1 / 3, atol=1e-3)
    assert sel.average_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]]), 0.5) == [0, 0, 1]


def test_tail_measures(spark):
    from tickloom.functions import kernels
    from tickloom.functions.statistics import tail_risk

    r = np.random.default_rng(2).standard_t(3, 1000) * 0.01
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(r)], "strategy_id long, t long, r double")
    x = tail_risk(df).first()
    assert x["cvar95"] <= x["var95"] < 0 and x["cvar99"] <= x["var99"] and 0 <= x["score"] <= 1
    e = kernels.extreme_value(df).first()
    assert e["evt_cvar"] <= e["evt_var"] < 0


def test_replies():
    from tickloom.functions.text import code_of, is_code, parse_json_reply

    assert parse_json_reply('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert parse_json_reply("so: {'a': {'b': 2}} ok") == '{"a": {"b": 2}}' and parse_json_reply("{'a': \"it's {\", 'b': None}") == '{"a": "it\'s {", "b": null}'
    assert parse_json_reply('{"strategy_name": "Test", "confidence": "high"}') == '{"confidence": "high", "strategy_name": "Test"}'
    assert parse_json_reply('Here is the result:\n{"strategy_name": "Test3"}') == '{"strategy_name": "Test3"}' and parse_json_reply("This is not JSON at all.") is None
    assert parse_json_reply("{ {bad} {\"a\": 1}") == '{"a": 1}' and parse_json_reply("{" * 50) is None and parse_json_reply("```\n[1, 2]") == "[1, 2]"
    assert parse_json_reply("nothing") is None and parse_json_reply(None) is None
    assert code_of("Sure:\n```python\nimport x\nclass A:\n    pass\nEnd.\n```") == "import x\nclass A:\n    pass"
    assert code_of("```python\nimport b as bt\n\nclass T(bt.S):\n    pass\n```").startswith("import b")
    assert code_of("Here is the code:\n\nimport b as bt\n\nclass T(bt.S):\n    pass\n\nThis strategy uses RSI for entries.") == "import b as bt\n\nclass T(bt.S):\n    pass"
    assert code_of("no code at all") == "" and code_of("") == ""
    assert is_code("a = 1") and not is_code("a =") and not is_code("") and not is_code(None)


def test_bar_files(spark, tmp_path):
    from tickloom.sources.files import coverage, query_lines, read_bars, spellings, upsert, write_bars

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "EUR_USD.csv").write_text("Date,Time,Open,High,Low,Close,Volume\n2024-01-02,03:04,1,2,0.5,1.5,\n2024-01-02,bad,1,2,0.5,1.5,7\n2024-01-02,05:00,1,2,0.5,x,7\n")
    (row,) = read_bars(spark, str(tmp_path / "a")).collect()
    assert (row["ts"].hour, row["close"], row["volume"]) == (3, 1.5, 0.0)  # the close is not the volume, the time of day stays
    assert coverage(["Open", "HIGH", " low "]) == 0.75 and "eur_usd" in spellings("EURUSD")
    bars = walk(spark, 5).withColumn("timeframe", F.lit("1hour"))
    write_bars(bars, str(tmp_path / "cache"))
    write_bars(bars.withColumn("timeframe", F.lit("1day")), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 10
    (tmp_path / "q.txt").write_text("# no\n\nmomentum\n")
    assert [r["query"] for r in query_lines(spark, str(tmp_path / "q.txt")).collect()] == ["momentum"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z")], "k long, v string")
    assert sorted(map(tuple, upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z")]


def test_prague_days(spark):
    from tickloom.operators.compliance import civil_day

    df = spark.createDataFrame([("2024-01-15 22:30:00",), ("2024-01-15 23:30:00",), ("2024-07-15 21:30:00",), ("2024-07-15 22:30:00",)], "s string").select(F.to_timestamp("s").alias("ts"))
    assert [r[0].day for r in df.select(civil_day("ts")).collect()] == [15, 16, 15, 16]


def test_verdict_rules(spark):
    from tickloom.operators.compliance import verdict

    def account(pnls):
        rows = [(1, datetime(2024, 1, 2) + timedelta(days=i), datetime(2024, 1, 2, 10) + timedelta(days=i), i, 1, 1, 1.0, 1.0, 0.0, float(p)) for i, p in enumerate(pnls)]
        return verdict(spark.createDataFrame(rows, "strategy_id long, entry_ts timestamp, exit_ts timestamp, order_key long, line int, variant_key long, entry_price double, size double, fee double, pnl double")).first()

    assert account([3000, 3000, 3000, 3000])["passes"]
    assert not account([6000, 6000, 100])["days_ok"] and not account([-5100, 9000, 9000, 9000])["daily_ok"]
    assert not account([-4000, -4000, -4000, 30000])["total_ok"]


def test_impact_grows_with_size(spark):
    from tickloom.operators.costs import execution_schedule, impact_bps, round_trip_bps

    df = spark.createDataFrame([(10.0,), (100.0,)], "s double")
    for m in ("sqrt", "almgren", "linear", "kyle"):
        a, b = [r[0] for r in df.select(impact_bps(m, F.col("s"), F.lit(1000.0), F.lit(0.02))).collect()]
        assert 0 < a < b
    one = df.select(impact_bps("sqrt", F.col("s"), F.lit(1000.0), F.lit(0.02)).alias("i")).select("i", round_trip_bps(F.col("i")).alias("r")).first()
    assert one["r"] > one["i"]
    with pytest.raises(ValueError):
        impact_bps("other", F.lit(1.0), F.lit(1.0), F.lit(1.0))
    plan = execution_schedule(spark.createDataFrame([(1, 500.0)], "order_id long, size double")).agg(F.sum("quantity"), F.count("slice")).first()
    assert math.isclose(plan[0], 500.0) and plan[1] == 10


def test_stream_state_equals_batch(spark, data):
    from tickloom.sources.views import ticks
    from tickloom.streaming.live import latest, run_available, stream_drift, stream_paper, tick_stream

    rows = ticks(spark, data).toPandas().sort_values(["ts", "tick_id"])
    drift = {r["symbol"]: r for r in latest(run_available(stream_drift(tick_stream(spark, data), 50.0, 50.0)), ["symbol"]).collect()}
    paper = {r["symbol"]: r for r in latest(run_available(stream_paper(tick_stream(spark, data), 20.0, 60.0)), ["symbol"]).collect()}
    for symbol, g in rows.groupby("symbol"):
        up = down = 0.0
        cash, position, fills = 1000.0, 0, 0
        for p in g["price"]:
            z = (p - 50) / 50
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            if position == 0 and p < 20:
                cash, position, fills = cash - p, 1, fills + 1
            elif position == 1 and p > 60:
                cash, position, fills = cash + p, 0, fills + 1
        assert math.isclose(drift[symbol]["cusum_up"], up, abs_tol=1e-9) and drift[symbol]["n"] == len(g)
        assert paper[symbol]["fills"] == fills and math.isclose(paper[symbol]["cash"], cash, abs_tol=1e-6)


def test_kill_switch_takes_the_first_of_equal_rules(spark):
    from tickloom.operators.control import kill_switch

    row = (1, 4.0, 6.0, 0.0, 26.0, 9, 1.0, 1.0, 1.0)
    df = spark.createDataFrame([row, (2, 0.0, 0.0, 0.0, 0.0, 0, 1.0, 1.0, 1.0)], "strategy_id long, daily_loss double, weekly_loss double, monthly_loss double, drawdown double, losses long, live_sharpe double, vol_ratio double, position_pct double")
    a, b = kill_switch(df).orderBy("strategy_id").collect()
    assert (a["action"], a["rule"], a["multiplier"]) == ("LIQUIDATE", "drawdown_liquidate", 0.0) and (b["action"], b["multiplier"]) == ("NONE", 1.0)


def test_cycles_end(spark):
    from tickloom.operators.lineage import ancestors

    s = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "strategy_id long, parent_id long")
    assert sorted(r["node"] for r in ancestors(s, s.filter("strategy_id = 3")).collect()) == [1, 2, 3]


def test_semantic_duplicates_are_all_found_in_order(spark, tmp_path):
    """T9 against a loop: near copies of 64 dimensions, chains whose middle goes, large ids, zeros; and blocks of any size."""
    import numpy as np

    from tickloom import catalog
    from tickloom.operators.selection import semantic_duplicates

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    x = [b + 0.5 * rng.normal(size=64) for b in base for _ in range(4)]
    for a in (0, 25, 50, 75, 100):
        x.append(10 * (np.cos(np.radians(a)) * np.eye(64)[0] + np.sin(np.radians(a)) * np.eye(64)[1]))
    x += [np.zeros(64), np.zeros(64), x[3], x[3]]
    order = rng.permutation(len(x) - 9).tolist() + list(range(len(x) - 9, len(x)))
    rows = [(n + (100_000_000 if n > 200 else 0), [float(v) for v in x[i]]) for n, i in enumerate(order)]
    accepted, want = [], {}
    for k, v in rows:
        near = [(-round(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), 9), j) for j, w in accepted if any(v) and any(w)]
        s, j = min(near, default=(0, None))
        want[k] = j if -s >= 0.85 else None
        if want[k] is None:
            accepted.append((k, v))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["T9_semantic_near_duplicates"](spark, str(tmp_path))
    assert dict(map(tuple, got.select("vec_id", "duplicate_of").collect())) == want
    assert dict(map(tuple, semantic_duplicates(docs, block=40).select("vec_id", "duplicate_of").collect())) == want


def test_running_and_ranks_over_ranges(spark):
    """Range partitions with offsets equal one window over the whole table, whatever the number of ranges."""
    from tickloom.operators.ordering import neighbours, numbered, running

    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 50)), float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g long, v double, x double").repartition(7)
    got = sorted((r["k"], r["rank"]) for r in numbered(df, [F.desc("v"), "k"]).collect())
    want = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == sorted(want.items())
    by_group = {r["k"]: (r["s"], r["m"]) for r in running(df, ["v", "k"], sums={"s": F.col("x")}, most={"m": F.col("x")}, by=["g"]).collect()}
    total, top = {}, {}
    for k, g, _, x in sorted(rows, key=lambda r: (r[2], r[0])):
        total[g], top[g] = total.get(g, 0.0) + x, max(top.get(g, -9.0), x)
        assert math.isclose(by_group[k][0], total[g], abs_tol=1e-9) and by_group[k][1] == top[g]
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    near = {r["k"]: (r["before"], r["after"]) for r in neighbours(df, "v", "k").collect()}
    assert near == {r[0]: (order[i - 1][2] if i else None, order[i + 1][2] if i + 1 < len(order) else None) for i, r in enumerate(order)}
    assert numbered(df.filter("false"), ["k"]).count() == 0


def test_long_chains_are_walked_whole(spark):
    from tickloom.operators.lineage import ancestors, descendants

    s = spark.createDataFrame([(i, i - 1 if i else None) for i in range(90)], "strategy_id long, parent_id long")
    down = sorted((r["node"], r["depth"]) for r in descendants(s, s.filter("strategy_id = 0")).collect())
    assert down == [(i, i) for i in range(90)]
    assert ancestors(s, s.filter("strategy_id = 89")).count() == 90


def test_pairs_and_searches_in_blocks(spark, monkeypatch):
    from tickloom.operators import pairs

    rng = np.random.default_rng(6)
    series = [rng.normal(0, 1, n).tolist() for n in (30, 25, 40, 2)] + [[0.5] * 20]
    days = [sorted(set(rng.integers(0, 12, 5).tolist())) for _ in series]
    p = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(zip(series, days, strict=True))], "strategy_id long, r array<double>, days array<int>")
    monkeypatch.setattr(pairs, "BLOCK", 2)
    corr = {}
    for i in range(5):
        for j in range(5):
            n = min(len(series[i]), len(series[j]))
            a, b = np.array(series[i][:n]), np.array(series[j][:n])
            if i != j and n >= 3 and a.std() > 1e-9 and b.std() > 1e-9:
                corr[i, j] = abs(np.corrcoef(a, b)[0, 1])
    got = {r["strategy_id"]: r for r in pairs.pair_summary(p, "corr").collect()}
    for i in range(5):
        own = {j: c for (x, j), c in corr.items() if x == i}
        assert (i in got) == bool(own)
        if own:
            assert got[i]["pairs"] == len(own) and math.isclose(got[i]["most"], max(own.values()), abs_tol=1e-8) and got[i]["partner"] == max(own, key=own.get) and math.isclose(got[i]["mean"], np.mean(list(own.values())), abs_tol=1e-8)


def test_fronts_and_children(spark):
    """NSGA-II's fronts against pairwise dominance; children lie near their parents and repeat."""
    from tickloom.operators.evolution import next_generation, select_fronts

    rng = np.random.default_rng(12)
    pts = rng.integers(0, 12, (60, 2)).astype(float)
    pool = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k long, a double, b double")
    left, fronts = set(range(60)), {}
    dominates = lambda x, y: pts[x][0] >= pts[y][0] and pts[x][1] <= pts[y][1] and tuple(pts[x]) != tuple(pts[y])
    for level in range(1, 60):
        now = {i for i in left if not any(dominates(j, i) for j in left)}
        fronts |= {i: level for i in now}
        left -= now
    got = {r["k"]: r["front"] for r in select_fronts(pool, ["a"], ["b"], "k", 25).collect()}
    assert len(got) == 25 and all(fronts[i] == f for i, f in got.items())
    last = max(got.values())
    assert {i for i, f in fronts.items() if f < last} <= set(got)
    assert select_fronts(pool.filter("false"), ["a"], ["b"], "k", 5).count() == 0
    parents = pool.filter("k < 6").withColumn("place", F.col("k") + 1)
    once, again = (sorted(map(tuple, next_generation(parents.repartition(n), "k", ["a", "b"], 3).collect())) for n in (1, 4))
    assert once == again and len(once) == 6
    for parent, place, a, _ in once:
        x, y = pts[parent][0], pts[(place - 2) % 6][0]
        assert min(x, y) - 0.1 * abs(x - y) - 1e-9 <= a <= max(x, y) + 0.1 * abs(x - y) + 1e-9
