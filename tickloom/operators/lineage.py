"""Strategy family trees: mutations, hypotheses, generations, ancestors and descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut, new_folder


def best_metrics(results: DataFrame) -> DataFrame:
    """The result with the best Sharpe ratio of each strategy: one row a strategy, so that joins do not fan out."""
    at = F.struct(F.coalesce("sharpe_ratio", F.lit(float("-inf"))), F.col("symbol"))
    return results.groupBy("strategy_id").agg(*[F.max_by(c, at).alias(c) for c in ("symbol", "sharpe_ratio", "total_return_pct", "max_drawdown_pct", "total_trades")], F.count(F.lit(1)).alias("runs"))


def mutation_success(strategies: DataFrame, results: DataFrame) -> DataFrame:
    best = best_metrics(results).select("strategy_id", "sharpe_ratio", "total_return_pct")
    return strategies.join(best, "strategy_id", "left").groupBy("mutation_type").agg(
        F.count(F.lit(1)).alias("strategies"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.avg("total_return_pct").alias("avg_return"), F.count_if(F.col("status") == "promoted").alias("promoted"),
        (100.0 * F.count_if(F.col("status") == "promoted") / F.count(F.lit(1))).alias("success_pct"),
    )


def generation_stats(strategies: DataFrame, results: DataFrame) -> DataFrame:
    best = best_metrics(results).select("strategy_id", "sharpe_ratio")
    g = strategies.join(best, "strategy_id", "left").groupBy(F.col("level").alias("generation")).agg(F.count(F.lit(1)).alias("strategies"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.max("sharpe_ratio").alias("best_sharpe"))
    before = F.lag("avg_sharpe", 1).over(Window.orderBy("generation"))  # one row a generation
    return g.withColumn("delta", F.coalesce(F.col("avg_sharpe") - before, F.lit(0.0)))


def lineage_summary(strategies: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return strategies.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("origin") == "scraped").alias("scraped"), n(F.col("origin") == "manual").alias("manual"), n(F.col("origin") == "mutation").alias("mutated"),
        n(F.col("status") == "active").alias("active"), n(F.col("status") == "promoted").alias("promoted"), n(F.col("status") == "retired").alias("retired"), F.max("level").alias("max_generation"), F.countDistinct("parent_id").alias("parents"),
    )


def improvements(strategies: DataFrame, results: DataFrame) -> DataFrame:
    """Each child with its parent: the child's best Sharpe less the parent's (self equi-join)."""
    best = best_metrics(results).select("strategy_id", "sharpe_ratio")
    s = strategies.join(best, "strategy_id")
    p = best.select(F.col("strategy_id").alias("parent_id"), F.col("sharpe_ratio").alias("parent_sharpe"))
    return s.join(p, "parent_id").filter("sharpe_ratio is not null and parent_sharpe is not null").select("strategy_id", "parent_id", "mutation_type", "hypothesis_id", "cost", (F.col("sharpe_ratio") - F.col("parent_sharpe")).alias("improvement"))


def mutation_report(improved: DataFrame) -> DataFrame:
    return improved.groupBy("mutation_type").agg(
        F.count(F.lit(1)).alias("children"), (F.count_if(F.col("improvement") > 0) / F.count(F.lit(1))).alias("success_rate"), F.avg("improvement").alias("mean"), F.median("improvement").alias("median"),
        F.max("improvement").alias("best"), F.min("improvement").alias("worst"), F.sum("cost").alias("cost"), F.try_divide(F.sum("improvement"), F.sum("cost")).alias("roi"),
    )


def mutation_weights(report: DataFrame) -> DataFrame:
    """Success rate times mean improvement plus 0.1, at least 0.01, made to sum to 1."""
    score = F.greatest(F.col("success_rate") * F.greatest(F.col("mean") + 0.1, F.lit(0.01)), F.lit(0.01))
    return report.select("mutation_type", score.alias("score")).withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy()))


def hypothesis_report(strategies: DataFrame, results: DataFrame) -> DataFrame:
    """Per hypothesis: strategies, mean and best Sharpe, and its slope over the order of ids."""
    s = strategies.join(best_metrics(results).select("strategy_id", "sharpe_ratio"), "strategy_id").filter("sharpe_ratio is not null")
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("hypothesis_id").orderBy("strategy_id")).cast("double"))
    return s.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("strategies"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.max("sharpe_ratio").alias("best_sharpe"), F.regr_slope("sharpe_ratio", "n").alias("slope"))


def prune_hypotheses(strategies: DataFrame, results: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """Hypotheses with enough strategies of which few hold up: the worst run keeps 0.8 of the best Sharpe."""
    runs = results.groupBy("strategy_id").agg(F.max("sharpe_ratio").alias("backtest"), F.avg("sharpe_ratio").alias("live"))
    g = strategies.join(runs, "strategy_id").groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("strategies"), (F.count_if(F.col("live") > 0.8 * F.col("backtest")) / F.count(F.lit(1))).alias("holding"))
    return g.filter((F.col("strategies") >= least) & (F.col("holding") < share))


def best_mutation_by_symbol(strategies: DataFrame, results: DataFrame) -> DataFrame:
    """The mutation type with the highest mean Sharpe for each symbol (the regime of a map of Sharpe ratios)."""
    maps = results.groupBy("strategy_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "sharpe_ratio"))).alias("sharpes"))
    means = strategies.join(maps, "strategy_id").select("mutation_type", F.explode("sharpes").alias("symbol", "sharpe")).groupBy("symbol", "mutation_type").agg(F.avg("sharpe").alias("mean_sharpe"))
    at = F.struct(F.coalesce("mean_sharpe", F.lit(float("-inf"))), "mutation_type")
    return means.groupBy("symbol").agg(F.max_by("mutation_type", at).alias("mutation_type"), F.max("mean_sharpe").alias("mean_sharpe"))


def _walk(strategies: DataFrame, start: DataFrame, down: bool, levels: int = 4) -> DataFrame:
    """Breadth-first walk of any depth, `levels` at a time; an id met again is not followed, so cycles end.

    A round joins the edges `levels` times to the frontier and keeps the least depth of every new (root, node). What is found
    goes to one stored table, which the next round reads, so that no plan grows with the depth.
    """
    spark = strategies.sparkSession
    edges = strategies.filter("parent_id is not null").select(F.col("parent_id" if down else "strategy_id").alias("node"), F.col("strategy_id" if down else "parent_id").alias("to"))
    edges = cut(edges.filter("to is not null").distinct(), "lineage-edges")
    path, kind = new_folder(spark, "lineage"), "root long, node long, depth long"
    known = lambda where: spark.read.schema(kind).parquet(f"{path}{where}").select("root", "node", "depth")
    at = start.select(F.col("strategy_id").alias("root"), F.col("strategy_id").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    at.write.parquet(f"{path}/from=0")
    depth = 0
    while True:
        seen = known("")
        step = known(f"/from={depth}").filter(F.col("depth") == depth)
        found = None
        for _ in range(levels):
            step = step.join(edges, "node").select("root", F.col("to").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
            found = step if found is None else found.union(step)
        new = found.groupBy("root", "node").agg(F.min("depth").alias("depth")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        depth += levels
        new.write.parquet(f"{path}/from={depth}")
        if known(f"/from={depth}").filter(F.col("depth") == depth).isEmpty():
            return known("")


def descendants(strategies: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth of everything below each root (and itself, at depth 0)."""
    return _walk(strategies, roots, down=True)


def ancestors(strategies: DataFrame, of: DataFrame) -> DataFrame:
    """root, node, depth of each strategy's ancestors (and itself)."""
    return _walk(strategies, of, down=False)


def top_lineages(strategies: DataFrame, results: DataFrame, n: int, generation: int = 3) -> DataFrame:
    """The best strategy of each family (ancestor in `generation`), for the n best families. Ids halve from child to parent."""
    s = strategies.join(best_metrics(results).select("strategy_id", "sharpe_ratio"), "strategy_id").filter((F.col("level") >= generation) & F.col("sharpe_ratio").isNotNull())
    family = F.expr(f"shiftright(strategy_id, CAST(level - {int(generation)} AS INT))")
    best = Window.partitionBy("family").orderBy(F.desc("sharpe_ratio"), "strategy_id")
    one = s.withColumn("family", family).withColumn("n", F.row_number().over(best)).filter("n = 1")
    return one.orderBy(F.desc("sharpe_ratio"), "strategy_id").limit(n).select("family", "strategy_id", "sharpe_ratio")
