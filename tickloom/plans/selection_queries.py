"""Queries of selection, diversification and portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_pdf
from ..operators import selection as sel
from ..operators.evolution import next_generation, select_fronts
from ..operators.ordering import running
from ..operators.pairs import pair_summary, profiles
from ..sources.storage import cut
from ..sources.views import results, returns, returns_of, strategies, trades
from ..sql import with_views
from .common import duck_normal, rounded
from .results_queries import r

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql)


REASONS = "list_filter([CASE WHEN sharpe_ratio < 0.3 THEN 'sharpe_too_low' END, CASE WHEN max_drawdown_pct > 30.0 THEN 'drawdown_too_high' END, CASE WHEN total_trades < 3 THEN 'too_few_trades' END, CASE WHEN total_return_pct < -100.0 THEN 'return_too_low' END], lambda x: x IS NOT NULL)"
parts = []
for m, wt, lo, hi, good in sel.SCORE:
    x = f"least(greatest(({m} - {lo}) / {hi - lo}, 0.0), 1.0)"
    parts.append((f"coalesce(CASE WHEN {m} IS NOT NULL THEN {wt} * {x if good else f'(1 - {x})'} END, 0)", f"CASE WHEN {m} IS NOT NULL THEN {wt} ELSE 0 END"))
SCORE = f"round(CAST(({' + '.join(a for a, _ in parts)}) / ({' + '.join(b for _, b in parts)}) AS DOUBLE) + 3e-11, 9)"
RANKED = f", f AS (SELECT *, {REASONS} AS reasons, {SCORE} AS score FROM results), k AS (SELECT *, row_number() OVER (ORDER BY CAST(len(reasons) > 0 AS INTEGER), score DESC NULLS LAST, strategy_id, symbol) AS rank FROM f)"
add("P1_hard_filters", lambda s, d: sel.hard_filters(results(s, d)).select("strategy_id", "symbol", F.concat_ws(";", "reasons").alias("reasons")), "results", f"SELECT strategy_id, symbol, array_to_string({REASONS}, ';') AS reasons FROM results")
add("P2_composite_score", lambda s, d: sel.composite_score(results(s, d)).select("strategy_id", "symbol", "score"), "results", f", f AS (SELECT strategy_id, symbol, {SCORE} AS score FROM results) SELECT strategy_id, symbol, {r('score')} FROM f")
add("P3_rank_top_n", lambda s, d: sel.rank_top(results(s, d), 100).groupBy("selected", F.concat_ws(";", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n")), "results", RANKED + ", z AS (SELECT len(reasons) = 0 AND rank <= 100 AS selected, CASE WHEN len(reasons) = 0 AND rank > 100 THEN 'below_top_n_cutoff' ELSE array_to_string(reasons, ';') END AS reasons FROM k) SELECT selected, reasons, count(*) AS n FROM z GROUP BY ALL")
add("P4_early_kill", lambda s, d: results(s, d).withColumn("kill", F.array_compact(F.array(F.when(F.col("total_trades") < 3, "trades"), F.when(F.col("sharpe_ratio") < 0, "sharpe"), F.when(F.col("max_drawdown_pct") > 30, "drawdown"), F.when(F.col("win_rate") < 30, "win_rate"), F.when(F.col("total_return_pct") < 0, "return")))).groupBy(F.size("kill").alias("hits")).count(), "results", "SELECT CAST(len(list_filter([total_trades < 3, sharpe_ratio < 0, max_drawdown_pct > 30, win_rate < 30, total_return_pct < 0], lambda x: x)) AS INTEGER) AS hits, count(*) AS count FROM results GROUP BY 1")
#: Every strategy with every other; each pair seen from both sides.
PAIRS = """, c AS (SELECT x.strategy_id AS a, y.strategy_id AS b, abs(covar_pop(x.r, y.r) / (stddev_pop(x.r) * stddev_pop(y.r))) AS corr
  FROM returns x JOIN returns y ON x.t = y.t AND x.strategy_id < y.strategy_id GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(x.r) > 1e-9 AND stddev_pop(y.r) > 1e-9),
dy AS (SELECT DISTINCT strategy_id, CAST(entry_ts AS DATE) AS day FROM trades), nn AS (SELECT strategy_id, count(*) AS n FROM dy GROUP BY 1),
j0 AS (SELECT x.strategy_id AS a, y.strategy_id AS b, count(*) AS common FROM dy x JOIN dy y ON x.day = y.day AND x.strategy_id < y.strategy_id GROUP BY ALL),
j AS (SELECT a, b, common / (p.n + q.n - common) AS jaccard FROM j0 JOIN nn p ON p.strategy_id = a JOIN nn q ON q.strategy_id = b),
s AS (SELECT a, b, 0.7 * coalesce(corr, 0) + 0.3 * coalesce(jaccard, 0) AS similarity FROM c FULL JOIN j USING (a, b))"""
SUMMARY = ", v AS (SELECT a, b, round({x} + 3e-11, 9) AS v FROM {t}), w AS (SELECT a AS strategy_id, b AS partner, v FROM v UNION ALL SELECT b, a, v FROM v)"
paired = lambda s, d: profiles(returns(s, d), trades(s, d))


def _pair_query(name: str, kind: str, source: str) -> None:
    sql = PAIRS + SUMMARY.format(x=kind, t=source) + f" SELECT strategy_id, count(*) AS pairs, {r('avg(v) AS mean', 'max(v) AS most')}, first(partner ORDER BY v DESC, partner) AS partner FROM w GROUP BY 1"
    add(name, lambda s, d: pair_summary(paired(s, d), kind).select("strategy_id", "pairs", "mean", "most", "partner"), "returns", sql)


_pair_query("J5_pair_correlations", "corr", "c")
_pair_query("P6_similarity", "similarity", "s")
_pair_query("P10_date_jaccard", "jaccard", "j")


def _shared_days(s, d):
    """Intersection and union of the sets of entry days of every strategy and its parent: arrays, no pairs of days."""
    x = paired(s, d).select("strategy_id", "days")
    p = x.select(F.col("strategy_id").alias("parent_id"), F.col("days").alias("of_parent"))
    both = strategies(s, d).select("strategy_id", "parent_id").join(x, "strategy_id").join(p, "parent_id")
    return both.select("strategy_id", F.size(F.array_intersect("days", "of_parent")).alias("common"), F.size(F.array_union("days", "of_parent")).alias("either"))


add("U4_jaccard", _shared_days, "strategies trades", ", dy AS (SELECT strategy_id, list(DISTINCT CAST(entry_ts AS DATE)) AS days FROM trades GROUP BY 1) SELECT s.strategy_id, CAST(len(list_intersect(x.days, y.days)) AS INTEGER) AS common, CAST(len(list_distinct(list_concat(x.days, y.days))) AS INTEGER) AS either FROM strategies s JOIN dy x ON x.strategy_id = s.strategy_id JOIN dy y ON y.strategy_id = s.parent_id")


def _aligned(s, d):
    """Every series cut to the length of the shortest."""
    x = returns(s, d)
    n = x.groupBy("strategy_id").agg(F.max("t").alias("n")).agg(F.min("n")).first()[0]
    return x.filter(F.col("t") <= F.lit(n)).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("r").alias("total"))


add("J10_positional_align", _aligned, "returns", f", n AS (SELECT min(n) AS n FROM (SELECT max(t) AS n FROM returns GROUP BY strategy_id)) SELECT strategy_id, count(*) AS rows, {r('sum(r) AS total')} FROM returns, n WHERE t <= n GROUP BY 1")


def _similarity_stats(s, d):
    """Mean and greatest similarity of all pairs, and the effective number of strategies: n (1 - mean over all cells of the matrix)."""
    x = paired(s, d)
    n = x.count()
    g = pair_summary(x, "similarity").agg((F.sum("total") / F.sum("pairs")).alias("mean"), F.max("most").alias("most"), F.sum("total").alias("total"))
    return g.select("mean", "most", (n * (1 - F.col("total") / (n * n))).alias("effective_n"))


add("P9_similarity_stats", _similarity_stats, "returns", PAIRS + SUMMARY.format(x="similarity", t="s") + f", z AS (SELECT count(DISTINCT strategy_id) AS n FROM trades) SELECT {r('avg(v) AS mean', 'max(v) AS most', 'any_value(z.n) * (1 - sum(v) / (any_value(z.n) * any_value(z.n))) AS effective_n')} FROM w, z")


def short(s, d, n: int):
    """The strategies of the n best results: a list that the ranking bounds, stored."""
    return cut(sel.best_of(results(s, d), n).groupBy("strategy_id").agg(F.max("score").alias("score")), "short")


def trades_of(s, d, chosen):
    """The trades of a short list's strategies, stored: its filter meets the line items before orders and windows do."""
    return cut(trades(s, d).filter(F.col("strategy_id").isin([x[0] for x in chosen.select("strategy_id").collect()])), "trades")


candidates = lambda s, d: sel.composite_score(sel.hard_filters(results(s, d))).filter(F.size("reasons") == 0).groupBy("strategy_id").agg(F.max("score").alias("score"))
add("P7_greedy", lambda s, d: sel.greedy(candidates(s, d), paired(s, d), 0.5))
ids = lambda s, d, n: sorted(x[0] for x in short(s, d, n).collect())


def _clusters(s, d):
    chosen = short(s, d, 40).select("strategy_id")
    t = trades_of(s, d, chosen)
    return sel.clusters(sel.similarities(returns_of(t), t, chosen), sorted(x[0] for x in chosen.collect()), 0.9)


add("P8_clusters", _clusters)
add("P11_portfolio_weights", lambda s, d: sel.portfolios(returns(s, d), ids(s, d, 8)))
add("P12_equal_weight_risk", lambda s, d: sel.portfolios(returns(s, d), ids(s, d, 8)).filter("method = 'equal'"))


def _portfolio(s, d):
    """Equity and drawdown of all strategies in equal parts, by place."""
    p = returns(s, d).groupBy("t").agg(F.avg("r").alias("r"))
    e = running(p, ["t"], sums={"s": F.log1p("r")}).select("t", "r", F.exp("s").alias("e"))
    return running(e, ["t"], most={"top": F.col("e")}).select("t", "r", "e", (1 - F.col("e") / F.greatest(F.lit(1.0), F.col("top"))).alias("dd"))


add("P13_portfolio_equity", _portfolio, "returns", f", p AS (SELECT t, avg(r) AS r FROM returns GROUP BY 1), e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY t)) AS e FROM p), q AS (SELECT *, 1 - e / greatest(1.0, max(e) OVER (ORDER BY t)) AS dd FROM e) SELECT t, {r('r', 'e', 'dd')} FROM q")


def _outer(s, d):
    """All series on the union of their places (1 to the longest), gaps filled from before, then from after.

    Every return stands for the places from its own up to the next return's, the first one for those before it, too: only
    returns are sorted, and the filled grid is never joined or sorted.
    """
    x = returns(s, d)
    last = x.agg(F.max("t")).first()[0] or 0
    w = Window.partitionBy("strategy_id").orderBy("t")
    f = F.coalesce(F.last("r", ignorenulls=True).over(w), F.first("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    spans = x.select("strategy_id", f.alias("f"), F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("t")).alias("a"), F.coalesce(F.lead("t").over(w) - 1, F.lit(last)).alias("b"))
    return spans.select("strategy_id", F.explode(F.sequence("a", "b")).alias("t"), "f")


add("J11_outer_align", _outer, "returns", f", g AS (SELECT t, strategy_id FROM (SELECT DISTINCT t FROM returns), (SELECT DISTINCT strategy_id FROM returns)), o AS (SELECT g.*, r FROM g LEFT JOIN returns USING (strategy_id, t)), q AS (SELECT *, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(r IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM o) SELECT strategy_id, t, {r('f')} FROM q")
obj = lambda s, d: results(s, d).groupBy("strategy_id").agg(F.round(F.avg("total_return_pct") + 3e-11, 6).alias("ret"), F.round(F.max("max_drawdown_pct") + 3e-11, 6).alias("dd"))
OBJ = ", o AS (SELECT strategy_id, round(avg(total_return_pct) + 3e-11, 6) AS ret, round(max(max_drawdown_pct) + 3e-11, 6) AS dd FROM results GROUP BY 1), f AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.ret >= a.ret AND b.dd <= a.dd AND (b.ret > a.ret OR b.dd < a.dd)))"
add("P14_pareto_front", lambda s, d: sel.pareto_front(obj(s, d), ["ret"], ["dd"], "strategy_id"), "results", OBJ + f" SELECT strategy_id, {r('ret', 'dd')} FROM f")
add("P15_crowding", lambda s, d: sel.crowding(sel.pareto_front(obj(s, d), ["ret"], ["dd"], "strategy_id"), ["ret", "dd"], "strategy_id").select("strategy_id", "crowding"), "results", OBJ + f", q AS (SELECT strategy_id, (lead(ret) OVER (ORDER BY ret, strategy_id) - lag(ret) OVER (ORDER BY ret, strategy_id)) / nullif(max(ret) OVER () - min(ret) OVER (), 0) + (lead(dd) OVER (ORDER BY dd, strategy_id) - lag(dd) OVER (ORDER BY dd, strategy_id)) / nullif(max(dd) OVER () - min(dd) OVER (), 0) AS crowding FROM f) SELECT strategy_id, {r('crowding')} FROM q")
pred = lambda s, d: results(s, d).groupBy("strategy_id").agg(F.avg("sharpe_ratio").alias("mu"), F.stddev_samp("sharpe_ratio").alias("sigma")).filter("sigma > 0")


def _acquire(s, d):
    z = (F.col("mu") - 3.0) / F.col("sigma")
    x = pred(s, d).withColumn("z", z).withColumn("ucb", F.col("mu") + 2.0 * F.col("sigma")).withColumn("pi", norm_cdf("z"))
    return x.withColumn("ei", (F.col("mu") - 3.0) * F.col("pi") + F.col("sigma") * norm_pdf(F.col("z"))).select("strategy_id", "ucb", "pi", "ei").orderBy(F.desc("ei"), "strategy_id").limit(25)


add("P19_acquisition", _acquire, "results", f""", p AS (SELECT strategy_id, avg(sharpe_ratio) AS mu, stddev_samp(sharpe_ratio) AS sigma FROM results GROUP BY 1 HAVING stddev_samp(sharpe_ratio) > 0),
q AS (SELECT *, (mu - 3.0) / sigma AS z FROM p), c AS (SELECT *, {duck_normal('z')} AS pi FROM q), e AS (SELECT strategy_id, mu + 2.0 * sigma AS ucb, pi, (mu - 3.0) * pi + sigma * exp(-z * z / 2) / sqrt(2 * pi()) AS ei FROM c ORDER BY ei DESC, strategy_id LIMIT 25)
SELECT strategy_id, {r('ucb', 'pi', 'ei')} FROM e""")
add("P19_upper_confidence", lambda s, d: pred(s, d).select("strategy_id", (F.col("mu") + 2.0 * F.col("sigma")).alias("ucb")), "results", f", p AS (SELECT strategy_id, avg(sharpe_ratio) AS mu, stddev_samp(sharpe_ratio) AS sigma FROM results GROUP BY 1 HAVING stddev_samp(sharpe_ratio) > 0) SELECT strategy_id, {r('mu + 2.0 * sigma AS ucb')} FROM p")
QUERIES["L8_acquisition_top_k"], ORACLE["L8_acquisition_top_k"] = QUERIES["P19_acquisition"], ORACLE["P19_acquisition"]
add("P20_kappa_schedule", lambda s, d: strategies(s, d).withColumn("x", F.col("level") / F.lit(20.0)).select("strategy_id", (4 - 3.5 * F.col("x")).alias("linear"), (4 * F.pow(F.lit(0.125), F.col("x"))).alias("exponential"), (0.5 + 1.75 * (1 + F.cos(F.pi() * F.col("x")))).alias("cosine")), "strategies", f", k AS (SELECT strategy_id, level / 20.0 AS x FROM strategies) SELECT strategy_id, {r('4 - 3.5 * x AS linear', '4 * pow(0.125, x) AS exponential', '0.5 + 1.75 * (1 + cos(pi() * x)) AS cosine')} FROM k")
FP = ["sharpe_ratio", "total_return_pct", "max_drawdown_pct", "win_rate"]


def _fingerprint(s, d):
    x = results(s, d).groupBy("strategy_id").agg(*[F.avg(c).alias(c) for c in FP]).na.drop()
    st = x.agg(*[F.avg(c).alias(f"m_{c}") for c in FP], *[F.stddev_pop(c).alias(f"s_{c}") for c in FP])
    return x.join(F.broadcast(st), how="cross").select("strategy_id", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in FP])  # one row of statistics


add("P22_fingerprint", _fingerprint, "results", ", x AS (SELECT strategy_id, " + ", ".join(f"avg({c}) AS {c}" for c in FP) + " FROM results GROUP BY 1), y AS (SELECT * FROM x WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FP) + "), z AS (SELECT strategy_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in FP) + f" FROM y) SELECT strategy_id, {r(*FP)} FROM z")


def _training(s, d):
    """Inputs and labels of the models, stored: every step of a fit reads them."""
    from pyspark.ml.feature import VectorAssembler

    x = results(s, d).na.drop(subset=["sharpe_ratio", "profit_factor"]).withColumn("label", (F.col("total_return_pct") > 1).cast("double"))
    x = cut(x.select("strategy_id", "symbol", "sharpe_ratio", "label", "max_drawdown_pct", "total_trades", "win_rate"), "training")
    return VectorAssembler(inputCols=["max_drawdown_pct", "total_trades", "win_rate"], outputCol="features").transform(x)


def _surrogate(s, d):
    """Forest, boosted and linear estimates of the Sharpe ratio: errors on rows that none of them was fitted to, a fifth by hash."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    x = _training(s, d).withColumn("held", F.pmod(F.xxhash64("strategy_id", "symbol"), F.lit(5)) == 0)
    fit, test, out = x.filter("not held"), x.filter("held"), None
    for name, model in (("forest", RandomForestRegressor(labelCol="sharpe_ratio", numTrees=10, maxDepth=4, seed=42)), ("boosted", GBTRegressor(labelCol="sharpe_ratio", maxIter=5, maxDepth=3, seed=42)), ("linear", LinearRegression(labelCol="sharpe_ratio", regParam=0.01))):
        error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("sharpe_ratio"), F.lit(2.0))))
        row = model.fit(fit).transform(test).agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), error.alias("rmse"), F.stddev_pop("sharpe_ratio").alias("sd"))
        out = row if out is None else out.unionByName(row)
    return out


def _meta(s, d):
    """Logistic meta-model of success, with a recommendation by probability and risk."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = _training(s, d)
    p = LogisticRegression(maxIter=20, regParam=0.01).fit(x).transform(x).withColumn("p", vector_to_array("probability")[1])
    risk = (F.col("total_trades") < 4).cast("int") * 0.3 + (F.col("max_drawdown_pct") > 10).cast("int") * 0.3
    rec = F.when((F.col("p") >= 0.7) & (risk < 0.3), "APPROVE").when((F.col("p") >= 0.4) | (risk < 0.5), "CAUTION").otherwise("REJECT")
    return p.groupBy(rec.alias("recommendation")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("success"), F.avg(2 * F.abs(F.col("p") - 0.5)).alias("confidence"))


add("P18_surrogate", _surrogate)
add("P23_meta_model", _meta)


add("P16_nsga_selection", lambda s, d: select_fronts(obj(s, d), ["ret"], ["dd"], "strategy_id", 30))


def _children(s, d):
    """The next generation of the 40 best strategies by mean Sharpe ratio: win rate and drawdown are the genes."""
    g = results(s, d).groupBy("strategy_id").agg(F.avg("sharpe_ratio").alias("s"), F.avg("win_rate").alias("g1"), F.avg("max_drawdown_pct").alias("g2")).filter("s is not null")
    best = g.orderBy(F.desc("s"), "strategy_id").limit(40)
    ranked = best.select("strategy_id", "g1", "g2", F.row_number().over(Window.orderBy(F.desc("s"), "strategy_id")).cast("long").alias("place"))
    return next_generation(cut(ranked, "parents"), "strategy_id", ["g1", "g2"], 1)


UNIT = lambda g: f"(('0x' || substr(md5('{g}|1|' || a.strategy_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
CHILD = lambda g: f"a.{g} + {UNIT(g)} * (b.{g} - a.{g}) + 0.1 * (2 * {UNIT('m' + g)} - 1) * abs(b.{g} - a.{g}) AS {g}"
add("P17_next_generation", _children, "results", f""", g AS (SELECT strategy_id, avg(sharpe_ratio) AS s, avg(win_rate) AS g1, avg(max_drawdown_pct) AS g2 FROM results GROUP BY 1 HAVING avg(sharpe_ratio) IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY s DESC, strategy_id) AS place, least(count(*) OVER (), 40) AS n FROM g QUALIFY place <= 40)
SELECT a.strategy_id AS parent, a.place, {r(CHILD('g1'), CHILD('g2'))} FROM k a JOIN k b ON a.place = b.place % b.n + 1""")


def _phase(s, d):
    """Filters, ranking, diversification and the overfitting check in one plan."""
    from ..functions.statistics import pbo, pbo_summary

    top = short(s, d, 30)
    t = trades_of(s, d, top)
    picked = sel.greedy(top, profiles(returns_of(t), t), 0.3)
    check = pbo_summary(pbo(returns_of(t)))
    return picked.join(top, "strategy_id").join(check, how="cross")  # one row of the check


add("P24_phase_one", _phase)
