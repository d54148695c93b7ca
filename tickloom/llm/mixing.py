"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a fixed hash of its id. A source that gives `b` words gives those of its
documents that come first in the order of (hash, id) as long as their sizes sum to at most `b`.
That prefix is found without sorting: sum sizes by (source, bucket of the hash), find the bucket
in which the budget ends, and refine only that bucket, three times by 1024. What remains of the
boundary bucket after that is a 2**30-th of the source, a document or two; only those are ordered, after
rows that are equal have been counted.

A larger budget always takes a superset (the thresholds are nested), and reruns agree, as nothing
depends on partitioning or on random numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table, unit_hash

BITS, LEVELS = 10, 3
#: Per-source tables up to this many rows (a few MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Equal rows that a task makes again.
PORTION = 100_000
#: ASCII white space as `[\x20\x09-\x0D]`.
SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: str) -> F.Column:
    """Number of maximal runs without white space (`[^\\x20\\x09-\\x0D]+`); null counts 0.

    One split; the empty strings before leading and after trailing white space are taken off.
    """
    parts = F.split(F.col(text), SPACE, -1)
    edges = (F.col(text).rlike("^[\\x20\\x09-\\x0D]")).cast("int") + (F.col(text).rlike("[\\x20\\x09-\\x0D]\\z")).cast("int")
    return F.when(F.col(text).isNull() | (F.octet_length(text) == 0), F.lit(0)).otherwise(F.size(parts) - edges).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> list[tuple[str | None, int, float]]:
    """Target words for each (source, size): `share` of all sizes, dealt by weight.

    Sources are ordered by code point, null last; `weights` repeat in that order. No target exceeds
    `most` times its source's size: the excess is dealt again, by weight, among the others.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(most * n, weights[i % len(weights)]) for i, (_, n) in enumerate(order)]
    budget, capped, open_weight = share * sum(n for _, n in order), 0.0, float(sum(w for _, w in rows))
    # The level l with sum(min(cap, w * l)) = budget is the largest (budget - caps) / (other weights)
    # over all prefixes of the sources by cap / weight.
    level = budget / open_weight if rows else 0.0
    for cap, w in sorted(rows, key=lambda x: x[0] / x[1])[:-1]:
        capped, open_weight = capped + cap, open_weight - w
        level = max(level, (budget - capped) / open_weight)
    return [(s, n, float(min(cap, w * level))) for (s, n), (cap, w) in zip(order, rows, strict=True)]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words that a mix takes of each document.

    Returns id, `size`, `source_size`, `target` (of the document's source) and `taken`. A source with
    target t and size s takes every document floor(t / s) times and the hash-first documents once more.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, after
    the others; rows that are equal in id and size are taken or left one by one: as many of them as the budget holds; an
    empty table gives no rows. Other columns of the input are ignored. The targets are worked out in the driver, from one row
    for each distinct source (a name and a sum); all else stays in tables.
    """
    spark = docs.sparkSession
    base = saved(
        docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__src"), word_count(text_col).alias("size"))
        .withColumn("__h", unit_hash(F.coalesce(F.col("__id").cast("string"), F.lit("")))),
        "mixing",
    )
    rows = [(r["__src"], r["s"]) for r in base.groupBy("__src").agg(F.sum("size").alias("s")).collect()]
    # The key of a source is its place in the order, so that null joins as well. Sums are whole, and so may be the budgets.
    plan = [(i, s, size, t, int(t // size) if size else 0, math.floor(t - (t // size) * size) if size else 0) for i, (s, size, t) in enumerate(targets(rows, weights, share, most))]
    frame = spark.createDataFrame(plan, "__k int, __src string, source_size long, target double, __times int, __budget long")
    by_source = lambda df: F.broadcast(df) if len(plan) <= BROADCAST_ROWS else df
    docs_k = base.join(by_source(frame), base["__src"].eqNullSafe(frame["__src"])).drop("__src")

    # level by level: (source, bucket) sums, the boundary bucket, and what comes before it
    shift = 40
    inside, state = docs_k.select("__k", "__h", "__id", "size"), frame.select("__k", "__budget", F.lit(0).cast("long").alias("__before"))
    for _ in range(LEVELS):
        shift -= BITS
        hist = inside.groupBy("__k", F.shiftright("__h", shift).alias("__cut")).agg(F.sum("size").alias("s"))
        upto = Window.partitionBy("__k").orderBy("__cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = hist.withColumn("c", F.sum("s").over(upto)).join(by_source(state.select("__k", "__budget", "__before")), "__k")
        beyond = summed.filter(F.col("__before") + F.col("c") > F.col("__budget"))
        state = saved(beyond.groupBy("__k", "__budget").agg(F.min("__cut").alias("__cut"), F.min(F.col("__before") + F.col("c") - F.col("s")).alias("__before")), "mixing-cuts")
        inside = inside.join(by_source(state.select("__k", "__cut")), "__k").filter(F.shiftright("__h", shift) == F.col("__cut")).drop("__cut")
    # the last boundary buckets hold a document or two for each source; equal rows are counted first
    peers = inside.groupBy("__k", "__h", "__id", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__k").orderBy("__h", "__id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = peers.withColumn("c", F.sum(F.col("size") * F.col("n")).over(upto)).join(by_source(state), "__k").filter(F.col("__before") + F.col("c") > F.col("__budget"))
    last = last.groupBy("__k", "__budget", "__before", "__cut").agg(F.min(F.struct("__h", "__id", "size", "n", "c")).alias("__end"))
    rest = F.col("__budget") - F.col("__before") - (F.col("__end.c") - F.col("__end.n") * F.col("__end.size"))
    edge = saved(last.select("__k", "__cut", "__end", F.floor(rest / F.col("__end.size")).alias("__some")), "mixing-ends")

    met = docs_k.join(by_source(edge), "__k", "left")
    place, end = F.struct("__h", "__id", "size"), F.struct("__end.__h", "__end.__id", "__end.size")
    top = F.shiftright("__h", shift)
    chosen = F.coalesce((top < F.col("__cut")) | ((top == F.col("__cut")) & (place < end)), F.lit(False))
    again = lambda take: F.col("size") * (F.col("__times") + take.cast("int"))
    columns = [F.col("__id").alias(id_col), "size", "source_size", "target"]
    plain = met.filter(~F.coalesce((F.col("__some") > 0) & place.eqNullSafe(end), F.lit(False)))
    out = plain.select(*columns, again(chosen).cast("long").alias("taken"))
    # equal rows of which the budget holds some: made again from their number, in portions
    some = edge.filter("__some > 0").join(by_source(frame), "__k").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__end.n") - 1) / PORTION))))
    some = some.repartition("__k", "__part").withColumn("__i", F.explode(F.sequence(F.col("__part") * PORTION, F.least((F.col("__part") + 1) * PORTION, F.col("__end.n")) - 1)))
    some = some.withColumns({"__id": F.col("__end.__id"), "size": F.col("__end.size")})
    return out.unionByName(some.select(*columns, again(F.col("__i") < F.col("__some")).cast("long").alias("taken")))


#: The same mix, by a running sum over the documents of each source.
OP8_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM k),
c AS (SELECT *, sum(2.0::DOUBLE * ss) OVER o AS cs, sum(w) OVER o AS cw, sum(w) OVER () AS tw, 1.5::DOUBLE * CAST(sum(ss) OVER () AS DOUBLE) AS b
      FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * ss / w, k ROWS UNBOUNDED PRECEDING)),
l AS (SELECT greatest(max(b / tw), max(CASE WHEN tw > cw THEN (b - cs) / (tw - cw) END)) AS l FROM c),
t AS (SELECT source, ss, least(2.0::DOUBLE * ss, w * l) AS target FROM w, l),
u AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS times FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target,
  CAST(size * times + CASE WHEN sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) <= target - times * ss THEN size ELSE 0 END AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by weights 5, 2, 1 to 150 % of all words."""
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLE = {"op8_mix_sources": OP8_SQL}
