"""Fuzzy line deduplication by MinHash (DataFrame functions only).

Lines are compared by their sets of 8-character shingles (UTF-16 units; a shorter line is one shingle). Of
each component of lines linked by a Jaccard similarity of 0.8 or more, the first occurrence stays, by
(document id, place); blank lines are never removed.

1. One pass makes a row for every 8 shingles, within generated code, and aggregates 18 MinHash values for each
   distinct line before any shuffle: copies of a line combine in the map tasks. The values are minima of a 32-bit
   hash under 18 masks, over all shingles of a line, whatever its length and however it repeats itself.
2. 6 bands of 3 values: a pair at 0.8 misses all with a probability of 0.014, a pair at 0.9 with one of 0.0004, equal sets never.
3. Every line of a band is verified, exactly, against two centres: the band's most frequent line (often what the others are
   edits of) and its smallest. The links' components are found by distributed union-find. Where a band still holds
   lines of several components, all pairs across them are verified, too, so no link that a band shows is lost. They
   meet as short rows, 1024 lines against 1024: a size and 1024 parities of the set's hashes. Parities that differ are at
   most as many as the shingles that only one set has, so that they exclude pairs, but never a link; the rest is verified
   exactly, once a pair. The links found are between components, and so is the second union-find.
4. Components' first occurrences stay.

Lines that hold many rows meet their component by broadcast of those few lines, and every two tiles of a band meet under a key
of their own, so that no task gathers them. Verification compares sets of 32-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import forget, saved, setting, spread_join, table

SHINGLE = 8
#: Lines are linked by a similarity of NEAR / OF, in whole numbers: their sets' common part is NEAR / (NEAR + OF) of both sizes' sum.
NEAR, OF = 4, 5
BANDS, ROWS = 6, 3
#: Shingles in a row, lines in a tile of a band, and words of 64 parities.
BLOCK, TILE, WORDS = 8, 1024, 16
#: Masks of the MinHash values: the fractional parts of multiples of the golden ratio, as 32-bit numbers.
MASKS = [((i + 1) * 0x9E3779B97F4A7C15 >> 20) % (1 << 32) - (1 << 31) for i in range(BANDS * ROWS)]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`doc`, `at` (from 0), `line` and its hash `k` for every line that is not blank."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    return rows.filter(F.trim("line", F.lit(" \t\n\x0b\f\r")) != "").withColumn("k", F.xxhash64("line"))


def _last(units: str) -> Column:
    return F.greatest(F.floor(F.octet_length(units) / 2).cast("int") - SHINGLE, F.lit(0))


def _shingles(texts: DataFrame) -> DataFrame:
    """Columns `h0` to `h7` in place of `u`: hashes of eight shingles a row, the last one again where a line has no more; `i` is the first one's place.

    Places are bits set and shifted (2 (i + j) + 1, `i` a multiple of 8): checked additions cost as much as the hash.
    """
    keys = [c for c in texts.columns if c != "u"]
    placed = texts.withColumn("last", _last("u")).select("*", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(BLOCK))).alias("i"))
    return placed.select(*keys, "i", *[F.expr(f"hash(substring(u, shiftleft(least(i | {j}, last), 1) | 1, {2 * SHINGLE}))").alias(f"h{j}") for j in range(BLOCK)])


def _sketches(lines: DataFrame) -> DataFrame:
    """`k`, `n` (occurrences), `doc` (the smallest that has it) and `bands` of every distinct line.

    Two lines with one hash `k` (expected for one pair in 2**64) are told by a second hash and left out: they stay.
    """
    hashed = _shingles(lines.select("doc", "k", F.xxhash64(F.lit(1), "line").alias("k2"), F.encode("line", "UTF-16BE").alias("u")))
    mins = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m).cast("int")) for j in range(BLOCK)])).alias(f"m{r}") for r, m in enumerate(MASKS)]
    out = hashed.groupBy("k").agg(F.count_if(F.col("i") == 0).alias("n"), F.min("doc").alias("doc"), F.min("k2").alias("lo"), F.max("k2").alias("hi"), *mins)
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return out.filter("lo = hi").select("k", "n", "doc", F.array(*bands).alias("bands"))


def _sets(members: DataFrame, lines: DataFrame, sketches: DataFrame) -> DataFrame:
    """`k`, `s`: the distinct shingle hashes of every line that shares a band."""
    # one document that has the line: no hot key, whatever the copies
    where = members.select("k").distinct().join(sketches.select("k", "doc"), "k").hint("shuffle_hash")
    texts = lines.join(where, ["k", "doc"]).groupBy("k").agg(F.first("line").alias("line")).select("k", F.encode("line", "UTF-16BE").alias("u"))
    blocks = _shingles(texts).select("k", F.array(*[f"h{j}" for j in range(BLOCK)]).alias("h"))
    # a sorted aggregate collects one line at a time; a hashed one would fall back to sorting, later
    with setting(members.sparkSession, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        return saved(blocks.groupBy("k").agg(F.collect_list("h").alias("s")).select("k", F.array_distinct(F.flatten("s")).alias("s")), "line-sets", **{"parquet.enable.dictionary": "false"})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of `pairs`, with line hashes `a` and `b`, whose shingle sets reach the threshold."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    # sizes bound the similarity: no intersection where it can't reach the threshold
    near = both.filter(OF * F.least(F.size("sa"), F.size("sb")) >= NEAR * F.greatest(F.size("sa"), F.size("sb")))
    # the common part is what a set has without its difference, which is short for a link
    common = F.size("sa") - F.size(F.array_except("sa", "sb"))
    return saved(near.filter((NEAR + OF) * common >= NEAR * (F.size("sa") + F.size("sb"))).select(*pairs.columns), "line-links")


def _marked(known: DataFrame, sets: DataFrame) -> DataFrame:
    """`known` with the sizes `z` of its lines' sets and their parities: bit i of `w0` to `w15` is the parity of the hashes that end on i."""
    hashes = known.select("k").distinct().join(sets, "k").select("k", F.explode("s").alias("h"))
    placed = hashes.select("k", F.expr(f"shiftrightunsigned(h, 6) & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, h & 63)").alias("bit"))
    words = [F.expr(f"bit_xor(if(word = {w}, bit, 0L))").alias(f"w{w}") for w in range(WORDS)]
    return saved(known.join(placed.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("z"), *words), "k"), "line-marks")


def _across(marked: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) of lines of a band, in different components (`ca`, `cb`), that sizes and parities don't exclude."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    dealt = marked.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("k"), tiles).cast("int"))
    names = ["k", "c", "z", *[f"w{w}" for w in range(WORDS)]]
    # every two tiles of a band meet under a key of their own
    x = dealt.select("band", F.col("tile").alias("ta"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tb"), *[F.col(c).alias(f"x{c}") for c in names])
    y = dealt.select("band", F.explode(F.sequence(F.lit(0), "tile")).alias("ta"), F.col("tile").alias("tb"), *[F.col(c).alias(f"y{c}") for c in names])
    differ = sum((F.bit_count(F.col(f"xw{w}").bitwiseXOR(F.col(f"yw{w}"))) for w in range(1, WORDS)), F.bit_count(F.col("xw0").bitwiseXOR(F.col("yw0"))))
    met = x.join(y, ["band", "ta", "tb"]).filter("xc <> yc AND (ta < tb OR xk < yk)")
    # sizes and counts of bits are small: no check of every addition
    with setting(marked.sparkSession, "spark.sql.ansi.enabled", "false"):
        met = met.filter(OF * F.least("xz", "yz") >= NEAR * F.greatest("xz", "yz")).filter((NEAR + OF) * differ <= (OF - NEAR) * (F.col("xz") + F.col("yz")))
    swap = F.col("xk") > F.col("yk")
    return met.select(*_ordered("xk", "yk"), F.when(swap, F.col("yc")).otherwise(F.col("xc")).alias("ca"), F.when(swap, F.col("xc")).otherwise(F.col("yc")).alias("cb")).distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc`, `at`, `component` of every line that goes: it is a copy, exact or near, of a line that comes first.

    `component` is the hash of one of its lines. Null texts have no lines; lines of documents with a null id stay;
    rows that repeat an id are one document whose lines repeat: the lines at equal places have one fate. Lines of any
    length are hashed whole; an empty table gives no rows; other columns are ignored.
    """
    lines = _lines(docs, id_col, text_col)
    sketches = saved(_sketches(lines), "line-sketches")
    bands = sketches.select("k", "n", F.explode("bands").alias("band"))
    # frequency first; the low bits of the hash decide ties
    weight = F.shiftleft(F.least("n", F.lit((1 << 31) - 1)), 31) + F.col("k").bitwiseAND(F.lit((1 << 31) - 1))
    shared = bands.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max_by("k", weight).alias("top"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
    members = saved(bands.select("k", "band").join(saved(shared.drop("hi"), "line-bands").hint("shuffle_hash"), "band"), "line-members")
    first = members.filter("k <> top").select(*_ordered("k", "top")).union(members.filter("k <> lo").select(*_ordered("k", "lo"))).distinct()
    first = saved(first, "line-pairs")
    sets = _sets(members, lines, sketches)
    links = _verified(first, sets)
    found = connected_components(links)
    # bands that still hold several components
    known = members.join(found.withColumnRenamed("v", "k"), "k", "left").select("band", "k", "size", F.coalesce("component", "k").alias("c"))
    open_ = known.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("band")
    known = saved(known.join(open_, "band"), "line-open")
    marked = _marked(known, sets)
    more = saved(_across(marked).join(first, ["a", "b"], "left_anti"), "line-pairs")
    second = connected_components(_verified(more, sets), "ca", "cb").select(F.col("v").alias("c"), F.col("component").alias("least"))
    # a component of the first links, or a line without one, and what it is linked to by the second ones
    found = found.select(F.col("v").alias("k"), F.col("component").alias("c")).union(second.select("c", "c")).distinct()
    found = found.join(second, "c", "left").select("k", F.coalesce("least", "c").alias("component"))
    # every line that is not alone in its component
    groups = sketches.select("k", "n").join(found, "k", "left").filter("n > 1 or component is not null").select("k", F.coalesce("component", "k").alias("component"), "n")
    groups, total = saved(groups, "line-groups"), sketches.agg(F.sum("n")).first()[0] or 0
    forget(sketches, members, first, sets, known, marked, more)
    placed = saved(spread_join(lines.select("doc", "at", "k"), groups, "k", total).select("component", "doc", "at"), "line-places")
    forget(groups)
    keep = placed.groupBy("component").agg(F.min("doc").alias("doc"))
    keep = placed.join(keep, ["component", "doc"]).groupBy("component", "doc").agg(F.min("at").alias("at"))
    return placed.join(keep, ["component", "doc", "at"], "left_anti").select("doc", "at", "component")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, with texts that lack repeated lines; a row left without any line that is not blank goes.

    Rows that had no such line before (null, empty or blank texts) stay as they are, and so do rows with a null id.
    """
    gone = repeated_lines(docs, id_col, text_col).groupBy("doc").agg(F.collect_set("at").alias("__gone"))
    both = docs.join(gone.select(F.col("doc").alias("__doc"), "__gone").hint("merge"), docs[id_col] == F.col("__doc"), "left")
    parts = F.split(F.col(text_col), "\n")
    # the places that stay, in order: array_except keeps the order of its first argument
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone")
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("__parts"), i)), "\n")
    cut = both.withColumn("__parts", parts).withColumn("__rest", F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(rest))
    cut = cut.filter(F.col("__gone").isNull() | F.col("__rest").rlike("\\S"))
    return cut.select([F.col("__rest").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document has, and which of them go as copies of lines elsewhere."""
    docs = table(spark, sf_dir, "documents")
    gone = repeated_lines(docs).groupBy("doc").agg(F.count(F.lit(1)).alias("n_removed"), F.sort_array(F.collect_set("at")).alias("removed"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    counts = docs.select("doc_id", n_lines.cast("long").alias("n_lines"))
    return counts.join(gone, counts["doc_id"] == gone["doc"], "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
