"""What the fourth round's review found, on tables that are made for it."""

import math

import pytest


@pytest.mark.parametrize("kind", ["corr", "jaccard", "similarity"])
@pytest.mark.parametrize("most, rows, columns", [(1000, 64, 2048), (7, 3, 2)])
def test_all_pairs_meet_in_packed_blocks(spark, monkeypatch, kind, most, rows, columns):
    """Series of many lengths, constant ones, gaps, no days, equal ones and equals in days alone: as loops over all pairs. No profile is copied for a block."""
    from tickloom.operators import pairs

    def of(s):
        if s in (7, 19, 30):
            return [0.1, 0.2, 0.15, 0.05], [1, 2, 3]
        r = [0.25] * 5 if s in (3, 4) else [((s * 7 + k * k * 3 + k * s) % 13 - 6) / 100 for k in range(1 + s % 9)]
        if s in (10, 11):
            r[1] = None
        return r, [] if s in (5, 6) else sorted({(s * 3 + k * (1 + s % 4)) % 40 for k in range(1 + s % 7)})

    data = {s: of(s) for s in range(33)}
    seen = {s: [] for s in data}
    for a, (ra, da) in data.items():
        for b, (rb, db) in data.items():
            both = [(x, y) for x, y in zip(ra, rb) if x is not None and y is not None]
            c = j = None
            if len(both) >= 3:
                mx, my = (sum(v[i] for v in both) / len(both) for i in (0, 1))
                vx, vy = sum((x - mx) ** 2 for x, _ in both), sum((y - my) ** 2 for _, y in both)
                if min(vx, vy) / len(both) > 1e-18:
                    c = abs(sum((x - mx) * (y - my) for x, y in both)) / math.sqrt(vx * vy)
            if set(da) & set(db):
                j = len(set(da) & set(db)) / len(set(da) | set(db))
            v = {"corr": c, "jaccard": j, "similarity": None if c is None and j is None else 0.7 * (c or 0) + 0.3 * (j or 0)}[kind]
            if a != b and v is not None:
                seen[a].append((round(v + 3e-11, 9), -b))
    want = {s: (len(x), sum(v for v, _ in x) / len(x), max(x)[0]) for s, x in seen.items() if x}
    for name, value in {"BLOCK": 5, "MOST": most, "ROWS": rows, "COLUMNS": columns}.items():
        monkeypatch.setattr(pairs, name, value)
    stored, plain = {}, pairs.cut
    monkeypatch.setattr(pairs, "cut", lambda df, label: stored.setdefault(label, plain(df, label)))
    frame = spark.createDataFrame([(s, *x) for s, x in data.items()], "strategy_id long, r array<double>, days array<int>")
    out = pairs.pair_summary(frame, kind)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x["strategy_id"]: x for x in out.collect()}
    assert {s: (x["pairs"], x["mean"], x["most"]) for s, x in got.items()} == {s: pytest.approx(x, abs=2e-9) for s, x in want.items()}
    for s, x in got.items():
        near = [-b for v, b in seen[s] if v > x["most"] - 2e-9]
        assert x["partner"] == min(near)
    assert stored["blocks"].count() > 1 and stored["blocks"].count() < stored["classes"].count()


@pytest.mark.parametrize("parts", [8, 5])
def test_combinations_are_added_up_in_arrays(spark, parts):
    """Each half of the parts and the rest, as loops over the returns; no row is joined with every combination."""
    import itertools

    import numpy as np
    from tickloom.functions import statistics as st

    series = {1: [0.01 * ((t * 7) % 5 - 2) for t in range(23)], 2: [0.02, -0.01, 0.03], 3: [0.5] * 16, 4: [0.1]}
    out = st.combination_sharpes(st.example_frame(spark, [(s, t + 1, v) for s, x in series.items() for t, v in enumerate(x)]), parts)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["combo"], r["strategy_id"]): (r["is_"], r["oos"]) for r in out.collect()}
    combos = list(itertools.combinations(range(parts), parts // 2))
    assert len(got) == len(combos) * len(series)

    def sharpe(x):
        return None if not x else 0.0 if len(x) < 2 or np.var(x, ddof=1) < 1e-18 else pytest.approx(np.mean(x) / np.std(x, ddof=1) * math.sqrt(252), abs=2e-9)

    for s, x in series.items():
        size, more = divmod(len(x), parts)
        part = [p for p in range(parts) for _ in range(size + (p < more))]
        for i, c in enumerate(combos):
            assert got[i, s] == (sharpe([v for v, p in zip(x, part) if p in c]), sharpe([v for v, p in zip(x, part) if p not in c]))


def test_rank_correlations_over_many_ranges(spark, monkeypatch):
    """Ties, negative zeros and groups that a range lacks or has alone; every row is dealt twice and joined with no count of values."""
    import numpy as np
    from tickloom.functions import statistics as st

    monkeypatch.setattr(st, "ROWS_A_TASK", 40)
    rng = np.random.default_rng(5)
    data = {g: [(float(a), float(b)) for a, b in zip(rng.integers(-9, 9, n) * 0.5 + k, rng.normal(0, 1, n).round(1))] for g, k, n in ((1, 0, 300), (2, 40, 50), (3, 0, 2), (4, 7, 1))}
    data[1] += [(0.0, -0.0), (-0.0, 0.0)] * 5
    data[5] = [(1.0, float(i)) for i in range(9)]
    df = spark.createDataFrame([(g, a, b) for g, x in data.items() for a, b in x] + [(1, None, 1.0), (6, 2.0, None)], "g int, x double, y double")
    stored, plain = {}, st.cut
    monkeypatch.setattr(st, "cut", lambda d, label: stored.setdefault(label, plain(d, label)))
    got = {r["g"]: (r["n"], r["spearman"]) for r in st.rank_correlation(df, ["g"], "x", "y").collect()}
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    for g, rows in data.items():
        x, y = (rank(v) for v in zip(*rows))
        want = pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12) if min(np.std(x), np.std(y)) > 0 else None
        assert got.pop(g) == (len(rows), want)
    assert not got and stored["ranks"].select("__part").distinct().count() > 4


def test_features_deal_trades_once(spark, data, monkeypatch, rows_of):
    """Results and all other figures share one shuffle of stored trades; trades without a strategy have a row of results, as in the SQL."""
    import duckdb
    from pyspark.sql import functions as F
    from tickloom import catalog
    from tickloom.operators import features as ft
    from tickloom.sources import views

    seen, plain = {}, ft.cut
    monkeypatch.setattr(ft, "cut", lambda df, label: seen.setdefault(label, df) and plain(df, label))
    read = views.table
    lost = lambda s, d, name: read(s, d, name) if name != "lineitem" else read(s, d, name).withColumn("l_partkey", F.when(F.col("l_partkey") > 3, F.col("l_partkey")))
    monkeypatch.setattr(views, "table", lost)
    got = catalog.queries()["V25_features"](spark, data).toPandas()
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{data}/orders.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (CASE WHEN l_partkey > 3 THEN l_partkey END AS l_partkey) FROM '{data}/lineitem.parquet'")
    want = c.execute(catalog.oracle_sql()["V25_features"]).df()
    known = lambda df: df.dropna(subset="strategy_id").astype({"strategy_id": int})
    assert rows_of(known(got)) == rows_of(known(want)) and len(got) == len(want) == len(known(want)) + 1
    figures = ["total_trades", "total_return_pct", "win_rate", "pass_rate", "cvar_95", "is_normal", "is_cost_viable", "stress_survival_pct"]
    assert rows_of(got[got["strategy_id"].isna()][figures]) == rows_of(want[want["strategy_id"].isna()][figures])
    made = seen["features"]
    assert len(made.collect()) == len(got) - 1 and "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()


def test_thresholds_read_stored_scores(spark, data, monkeypatch):
    """The scores are made by a projection, which finds the text in lower case once, and not by the filter over them."""
    from tickloom import catalog
    from tickloom.plans import text_queries as q

    seen, plain = {}, q.cut
    monkeypatch.setattr(q, "cut", lambda df, label: seen.setdefault(label, df) and plain(df, label))
    out = catalog.queries()["T4_score_threshold"](spark, data)
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = [r["doc_id"] for r in seen["scores"].collect() if r["quality_score"] >= 0.3]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want) and 0 < len(want) < seen["scores"].count()
