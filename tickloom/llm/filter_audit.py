"""How filters interact: what each removes at every step of every order, and its exact Shapley share.

Each document fails some of the filters: a bit for each makes its mask. Counting documents by mask is all that reads texts; a
coalition S of filters removes v(S) documents, those whose mask meets S, and the 2**n coalition removals are tabulated from
the counts. From then on nothing depends on the number of documents: the filter after P removes v(P + f) - v(P), and the Shapley
shares are the least-squares fit of v by sums of shares, weighted by the Shapley kernel, with v(all) met exactly. The normal
equations have the same matrix for every v, so they are solved once, in rationals, for the coefficient of each v(S).
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import SPACE, word_count
from .shared import saved, table

#: Filters by letter: what fails. E, a text that a smaller id has, is added to those that look at one document.
COPY = "E"


def conditions(text: str) -> dict[str, Column]:
    """Failure conditions A to D of a text column without nulls; words are maximal runs without ASCII white space."""
    n = word_count(text)
    distinct = F.size(F.array_distinct(F.filter(F.split(F.col(text), SPACE, -1), lambda w: F.octet_length(w) > 0)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": distinct * F.lit(100).cast("long") < n * 65,
        "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def shapley_coefficients(n: int) -> list[list[int]]:
    """For each of n players, the coefficient of v(S), S = 0 .. 2**n - 1 as bits, in n! times its Shapley value.

    Minimises the sum over S, neither empty nor full, of k(S) (v(S) - sum of x[i], i in S)**2, where
    k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), under x[0] + ... + x[n-1] = v(all) - v(none). With a multiplier for the constraint,
    these are n + 1 linear equations; Gauss-Jordan elimination on fractions solves them for all right sides at once.
    """
    full, size = (1 << n) - 1, 1 << n
    if n == 1:
        return [[-1, 1]]
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    rows = []
    for i in range(n):
        inside = [(s, w) for s, w in weight.items() if s >> i & 1]
        left = [sum((w for s, w in inside if s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
        right = [Fraction(0)] * size
        for s, w in inside:
            right[s] += w
            right[0] -= w  # v(none) is the origin
        rows.append(left + right)
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction((s == full) - (s == 0)) for s in range(size)])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    out = [[x * factorial(n) for x in rows[i][n + 1 :]] for i in range(n)]
    assert all(x.denominator == 1 for r in out for x in r)
    return [[int(x) for x in r] for r in out]


def masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row a document: `part`, `mask` (bit i: fails filter i, E last), `good` and `toxic` as 0 or 1.

    Copies are found by the SHA-256 of the text: the smallest id of each text is an aggregate, and documents meet it again by
    (text, id), which spreads the copies of one text over all tasks. Texts are read once; what is stored has some 50 bytes a row.
    """
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions("text").values())]
    own = saved(text.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("key")), "audit")
    first = own.groupBy("key").agg(F.min("id").alias("id")).filter(F.col("id").isNotNull()).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic"))).filter(F.col("id").isNotNull())
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    met = own.join(first, ["key", "id"], "left").join(known, "id", "left")
    return met.select("part", (F.col("mask") + F.when(copy, F.lit(1 << len(bits))).otherwise(F.lit(0))).alias("mask"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def total(longs: Column) -> Column:
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: a + x)


def coalitions(rows: DataFrame, n: int) -> DataFrame:
    """One row a part: `v`, for each coalition 0 .. 2**n - 1 the documents, good and toxic ones that it removes, and `total`.

    Documents are counted by (part, mask) before anything moves; a part then has at most 2**n counts.
    """
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("all"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.sum("all").alias("total"), F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("m"))

    def removed(s: Column) -> Column:
        met = F.filter("m", lambda x: x["mask"].bitwiseAND(s) != 0)
        return F.struct(*(total(F.transform(met, lambda x: x[c])).alias(c) for c in ("all", "good", "toxic")))  # noqa: B023

    return parts.select("part", "total", F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), removed).alias("v"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What five filters remove, by part, order and step.

    Returns a row for each part (a value of `part_col`; null is the empty string), each of the 120 orders of ABCDE and each step
    1 .. 5: `kept` after the step, `removed` by it, `redundant` (fails this filter, gone before), `unique_fails` (fails this
    filter only), `good_lost` and `toxic_lost` (of `removed`, those that `labels` calls quality = 1 and toxic = 1), and `shapley`
    (`removed` of this filter summed over all orders).

    Null texts are empty. Rows that repeat an id are documents of their own and no copies of each other; a row with a null id is
    counted, is no copy, makes no other row one and has no label. Repeated or contradicting label rows: a document is good if any
    row says so, and likewise toxic; null labels say nothing. An empty table gives no rows. Other columns are ignored.
    """
    letters = [*conditions(text_col), COPY]
    n, everything = len(letters), (1 << len(letters)) - 1
    parts = coalitions(masks(docs, labels, id_col, text_col, part_col), n)
    orders = ",".join("".join(p) for p in permutations(letters))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))
    place = F.instr(F.lit("".join(letters)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    steps = steps.withColumns({"before": before, "place": place}).withColumn("bit", F.get(F.lit([1 << i for i in range(n)]), "place"))
    v = lambda s, c: F.get("v", s)[c]
    gain = lambda c: v(F.col("before") + F.col("bit"), c) - v(F.col("before"), c)
    table_of = F.array(*(F.array(*(F.lit(x).cast("long") for x in r)) for r in shapley_coefficients(n)))
    mine = F.get(table_of, F.col("place"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - v(F.col("before") + F.col("bit"), "all")).alias("kept"),
        gain("all").alias("removed"),
        (v(F.col("bit"), "all") - gain("all")).alias("redundant"),
        (v(F.lit(everything), "all") - v(F.lit(everything) - F.col("bit"), "all")).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        total(F.zip_with(mine, "v", lambda c, x: c * x["all"])).alias("shapley"),
    )


#: Every order walked with its own counts; the Shapley share is the sum over all walks.
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
g AS (SELECT *, contains(fails, f) AS hit, len(earlier) > 0 AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone FROM c, s),
r AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source, in all 120 orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE = {"op13_filter_audit": OP13_SQL}
