"""What the third round's review found, on tables that are made for it."""

import datetime as dt

import pytest

from tickloom import catalog

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture
def against(spark, tmp_path, rows_of):
    """Compares a query with its SQL over (order, strategy, supplier, line, quantity, price, discount, tax, flag, ordered, shipped) rows."""
    import duckdb

    def run(name, trades):
        d = str(tmp_path)
        spark.createDataFrame([(*t[:9], "F", t[10]) for t in trades], COLUMNS).write.parquet(f"{d}/lineitem.parquet")
        spark.createDataFrame(sorted({(t[0], t[9]) for t in trades}), "o_orderkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
        c = duckdb.connect()
        c.execute("SET timezone = 'UTC'")
        for t in ("lineitem", "orders"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        got, want = catalog.queries()[name](spark, d).toPandas(), c.execute(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
        return got

    return run


def test_days_end_by_one_rule_in_all_years(against):
    """22 o'clock UTC in October 1995 is the next day by the rule of the SQL, though that year's zone had no summer time by then."""
    day = lambda y, m, d: dt.datetime(y, m, d)
    rows = [(22, 1, 1, 1, 10.0, 1000.0, 0.05, 0.0, "A", day(1995, 10, 1), day(1995, 10, 7)), (24, 1, 1, 2, 10.0, 1000.0, 0.05, 0.0, "A", day(1995, 10, 1), day(1995, 10, 8)),
            (22, 2, 1, 3, 10.0, 1000.0, 0.05, 0.0, "A", day(1995, 10, 1), day(1999, 7, 3)), (24, 2, 1, 4, 10.0, 1000.0, 0.05, 0.0, "A", day(1995, 10, 1), day(1999, 7, 4))]
    assert against("K5_daily_loss", rows)["days"].tolist() == [1, 1]


def test_open_trades_are_marked_in_one_pass(spark, against):
    """Overlapping and same-day trades, shorts; and no join of exits with trades, whose rows grow with the square of those in a month."""
    day = lambda d: dt.datetime(1997, 1, 1) + dt.timedelta(days=d)
    rows = [(k, k % 2, 1, 1 + k % 4 // 3, float(1 + k % 7), 100.0 * (k + 1), k % 5 / 100, k % 3 / 100, "AR"[k % 2 * (k % 3 == 0)], day(k % 11), day(k % 11 + k % 6 * 9)) for k in range(60)]
    rows += [(100, 7, 1, 1, 1.0, 10.0, 0.0, 0.0, "A", day(3), day(3))]
    got = against("K4_unrealised", rows)
    assert got["marks"].sum() > 100 and (got["marks"] == 0).any()


def test_marks_join_nothing_but_trades_and_orders(spark, data):
    plan = catalog.queries()["K4_unrealised"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("name", ["J5_pair_correlations", "P10_date_jaccard", "P6_similarity", "P9_similarity_stats"])
def test_equal_profiles_are_one_class(name, against, monkeypatch):
    """Seven strategies that trade alike, some alone and a pair that is alike in days only: as the SQL over all pairs, with one class for the seven."""
    from tickloom.operators import pairs

    day = lambda d: dt.datetime(1997, 1, 1) + dt.timedelta(days=d)
    rows = []
    for s in range(12):
        shape = 0 if s < 7 else s if s < 10 else 10
        for k in range(6):
            rows.append((100 * s + k, s, 1, 1, 1.0, 100.0, ((shape * 7 + k * k * (s if s > 9 else 3)) % 11) / 100, 0.02, "A", day(shape * 2 + k), day(shape * 2 + k + 1)))
    stored, plain = {}, pairs.cut
    monkeypatch.setattr(pairs, "cut", lambda df, label: stored.setdefault(label, plain(df, label)))
    monkeypatch.setattr(pairs, "BLOCK", 3)
    against(name, rows)
    assert stored["classes"].count() == (5 if name == "P10_date_jaccard" else 6) and stored["profiles"].count() == 12


@pytest.fixture
def counted(spark):
    """Rows that let themselves be counted whenever they are made, and the count so far."""

    def run(df):
        made = spark.sparkContext.accumulator(0)

        def count(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema), made

    return run


@pytest.mark.parametrize("name", ["P8_clusters", "P24_phase_one", "P12_equal_weight_risk"])
def test_short_lists_read_results_once_and_no_other_trades(spark, data, counted, monkeypatch, name):
    from tickloom.plans import selection_queries as q
    from tickloom.sources.views import results

    whole = results(spark, data).cache()
    rows, made = counted(whole.coalesce(1))
    monkeypatch.setattr(q, "results", lambda s, d: rows)
    got, want = catalog.queries()[name](spark, data).toPandas(), whole.count()
    assert len(got) and made.value == want


def test_fronts_and_crowding_make_their_rows_once(spark, counted):
    from tickloom.operators import selection as sel

    df = spark.range(200).selectExpr("id", "cast(id * 37 % 101 as double) as a", "cast(id * 53 % 97 as double) as b").coalesce(1)
    rows, made = counted(df)
    front = sel.crowding(sel.pareto_front(rows, ["a"], ["b"], "id"), ["a", "b"], "id")
    assert front.count() == sel.pareto_front(df, ["a"], ["b"], "id").count() > 2 and made.value == 200


@pytest.mark.parametrize("module, name", [("selection", "P23_meta_model"), ("report", "P23_held_out"), ("surface", "S26_model_store"), ("models", "P19_thompson_picks"), ("models", "P17_archive"), ("models", "P17_generations")])
def test_models_read_results_once(spark, data, counted, monkeypatch, module, name):
    import importlib

    from tickloom.sources.views import results

    whole = results(spark, data).cache()
    rows, made = counted(whole.coalesce(1))
    monkeypatch.setattr(importlib.import_module(f"tickloom.plans.{module}_queries"), "results", lambda s, d: rows)
    assert len(catalog.queries()[name](spark, data).toPandas()) and made.value == whole.count()


def test_combinations_are_neither_grouped_nor_shuffled(spark):
    """Combinations are made beside each strategy's parts; a strategy with too few trades for one side has none there."""
    from tickloom.functions import statistics as st

    df = st.example_frame(spark, [(1, t, 0.01 * (t % 3)) for t in range(1, 17)] + [(2, t, 0.02 * t) for t in range(1, 4)])
    both = st.combination_sharpes(df)
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    rows = both.toPandas()
    assert len(rows) == 140 and rows[rows.strategy_id == 1].notna().all().all()
    assert rows[rows.strategy_id == 2]["is_"].isna().sum() == 5 == rows[rows.strategy_id == 2]["oos"].isna().sum()


def test_series_are_filled_without_a_grid(spark, monkeypatch):
    """Gaps, nulls and late starts; the filled places are made from the returns alone."""
    from tickloom.plans import selection_queries as q

    df = spark.createDataFrame([(1, 2, 0.1), (1, 4, None), (1, 5, 0.3), (2, 1, None), (2, 3, 0.5), (2, 6, 0.6)], "strategy_id long, t long, r double")
    monkeypatch.setattr(q, "returns", lambda s, d: df)
    out = catalog.queries()["J11_outer_align"](spark, "")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    want = {1: [0.1, 0.1, 0.1, 0.1, 0.3, 0.3], 2: [0.5, 0.5, 0.5, 0.5, 0.5, 0.6]}
    assert got == pytest.approx({(s, t + 1): v for s, x in want.items() for t, v in enumerate(x)})


def test_first_rows_are_found_without_sorting(spark):
    from tickloom.sources.files import keep_first, merge_years

    df = spark.createDataFrame([("a", 1, 2003, 1.0), ("a", 1, 2001, None), ("a", 2, 2002, 3.0), ("a", 2, None, 4.0), (None, 1, 2009, 5.0)], "symbol string, ts long, year int, v double")
    first = keep_first(df, ["symbol", "ts"], ["year"])
    assert "Sort" not in first._jdf.queryExecution().executedPlan().toString() and first.columns == df.columns
    assert {tuple(r) for r in first.collect()} == {("a", 1, 2001, None), ("a", 2, None, 4.0), (None, 1, 2009, 5.0)}
    assert merge_years(df).columns == ["symbol", "ts", "v"]


def test_groups_share_batches(spark):
    """Groups of one row, of more than a batch, and without a key come whole to the caller's function, whole numbers as such, in few batches."""
    from tickloom.operators import hooks

    df = spark.sql("select case when id < 25000 then 7 when id < 25005 then null else id end as k, case when id = 25001 then null else cast(id as int) end as v from range(25300)")
    fn = lambda pdf: {"n": len(pdf), "v": pdf["v"].sum(), "whole": float(pdf["v"].dtype == "int32" and list(pdf.columns) == ["k", "v"] and pdf.index[0] == 0)}
    out = hooks.backtest_each(df, "k", fn, ["n", "v", "whole", "none"])
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == 297 and got[7] == (25000, sum(range(25000)), 1.0, None) and got[None] == (5, 100009, 0.0, None) and got[25299] == (1, 25299, 1.0, None)


def test_tails_of_many_series_share_a_batch(spark):
    from tickloom.functions import kernels, statistics as st

    df = st.example_frame(spark, [(s, t, ((t * 37 + s) % 50 - 25) / 100) for s in range(3) for t in range(1, 61)] + [(9, 1, 0.1)])
    out = kernels.extreme_value(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in out.collect()) == [0, 1, 2]


def test_orders_of_simulations_are_made_once_for_a_length():
    import numpy as np

    from tickloom.functions import statistics as st

    key = st._drawn(np.arange(1, 1001)[:, None], np.arange(1, 31)[None, :], 999_983)
    assert (st._orders(30, 1, 1000) == np.argsort(key, axis=1, kind="stable")).all() and st._orders(30, 1, 1000) is st._orders(30, 1, 1000)
    assert set(np.unique(st._signs(30, 1, 40))) == {-1.0, 1.0} and st._signs(30, 1, 40) is st._signs(30, 1, 40)


@pytest.mark.parametrize("name", ["P22_fingerprints", "P22_importances", "P22_parent_similarity"])
def test_fingerprints_read_trades_once(spark, data, counted, monkeypatch, name):
    """One stored table of trades serves results, curves, stress, regimes and streaks; importances take growth from the same pass."""
    from tickloom.plans import report_queries as q
    from tickloom.sources.views import trades

    whole = trades(spark, data).cache()
    rows, made = counted(whole.coalesce(1))
    monkeypatch.setattr(q, "trades", lambda s, d: rows)
    for other in ("results", "returns"):
        monkeypatch.setattr(q, other, None)
    assert len(catalog.queries()[name](spark, data).toPandas()) and made.value == whole.count()


def test_one_pass_says_what_separate_figures_say(spark, rows_of):
    """Ties, a lone trade, only losses, null prices within a run of losses, trades without a day."""
    from tickloom.functions import statistics as st
    from tickloom.operators import features as ft
    from tickloom.sources.views import priced, returns_of

    day = lambda k: dt.datetime(1997, 1, 1) + dt.timedelta(days=k)
    rows = [(k % 5, k, 1 + k % 3, k % 4, day(k // 6 % 9), None if k % 5 == 3 else day(k // 4 % 9), 10.0 + k % 7, None if k % 17 == 4 else 9.0 + (k * k) % 11, -2.0 if k % 7 == 1 else 3.0) for k in range(120)]
    rows += [(7, 1, 1, 1, day(1), day(2), 10.0, 9.0, 1.0), *[(8, k, 1, 1, day(1), day(3), 10.0, 9.5, 1.0) for k in range(4)], (8, 0, 1, 1, day(1), day(3), 10.0, 9.5, 1.0)]
    tra = priced(spark.createDataFrame(rows, "strategy_id long, order_key long, line int, variant_key long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, size double")).cache()
    ret = returns_of(tra)
    want = tra.select("strategy_id").distinct()
    streak = st.losing_streak(ret, "strategy_id", ["t"], "r").withColumnRenamed("longest", "max_consecutive_losses")
    for part in (ft.path(ret), ft.stress(ret), ft.regimes(tra), ft.trading(tra).select("strategy_id", "avg_trade_pct"), streak):
        want = want.join(part, "strategy_id", "left")
    got = ft.history(tra, ft.market_days(tra))
    assert sorted(got.columns) == sorted(want.columns) and got.count() == 7
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())


def test_larger_tables_have_more_partitions(spark):
    from tickloom.sources.storage import ROWS_A_TASK, shuffles_for

    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError):
        with shuffles_for(spark, 100 * ROWS_A_TASK + 1):
            assert spark.conf.get(key) == "101"
            raise KeyError
    assert spark.conf.get(key) == before
    with shuffles_for(spark, 10):
        assert spark.conf.get(key) == before
