"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

A test item is found in a document if the document holds at least a share t (0.8) of the item's
distinct shingles (runs of five words). Items are short and documents may be long, so that the Jaccard
similarity of a pair is near 0 and plain banding would miss it. Instead:

* An item's sketch is a bottom-k MinHash: the k smallest of its n shingle hashes, with
  k = n - ceil(t n) + 1. A document that holds ceil(t n) of the n shingles lacks at most k - 1 of
  them, so it holds one of the sketch: the search misses nothing.
* Items are partitioned by size, in powers of two. A partition's items can only be in documents with
  enough shingles, and a document's shingle is looked up only if its hash is not above the largest hash in the
  sketches of the partitions that the document is large enough for: large items have low sketches. Items below five words
  are a partition of their own, which only documents below five words look up.
* Documents that meet a sketch are verified: distinct shingles of the item that the document has are
  counted exactly.

Shingles are made in the same generated code as the lookup: words are split once per document, and a
row for each place holds one hash of five words; no row leaves the scan without a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

WORDS, CONTAINMENT = 5, 0.8
#: Sketches and item shingles up to this many rows (16 bytes each, some MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
SALTS = 64


def _words(text: str) -> F.Column:
    """Lower-case words: what lies between runs of characters that are no letters, digits or marks."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}\\p{M}]+", " ")), " ")


def shingles(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """`id`, `h` for every place where a run of `words` words begins; texts with fewer words, but some, give one row; not distinct."""
    base = docs.select(F.col(id_col).alias("id"), _words(text_col).alias("w"))
    last = F.greatest(F.size("w") - words, F.lit(0))
    placed = base.select("id", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    parts = [F.get("w", F.col("i") + k) for k in range(words)]
    return placed.filter(F.get("w", F.col("i")) != "").select("id", F.xxhash64(*parts).alias("h"))


def _joined(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """Rows of documents (`id`, `h`, ...) with those of items: by broadcast, or by shuffle with `SALTS` copies of the items' rows."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), "h")
    # a shingle that very many documents share is dealt to as many tasks as there are salts
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(salted, ["h", "salt"]).drop("salt")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of a document and an item that it holds: id, item id, `n_shingles` of the item, `n_found`, `containment`.

    Null and empty texts hold nothing and are held by nothing; an item of fewer than five words is one
    shingle, held only by a text of just these words; items that repeat a text are found one by one;
    items that repeat an id count as one with all their shingles. Rows that repeat a document give its pairs once.
    Empty tables give no rows; other columns are ignored; rows with a null id are left out.
    """
    items = items.filter(F.col(item_id).isNotNull())
    docs = docs.filter(F.col(id_col).isNotNull())
    known = shingles(items, item_id, item_text).distinct().select(F.col("id").alias("item"), "h")
    brief = items.select(F.col(item_id).alias("item"), F.size(_words(item_text)).alias("w")).groupBy("item").agg(F.max("w").alias("w"))
    sizes = known.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("h")).alias("hs")).join(brief, "item")
    # an item is bounded by its own text; 1e-9 guards the product against rounding
    need = F.ceil(F.col("n") * F.lit(containment) - 1e-9)
    sized = saved(sizes.select("item", "n", "hs", need.alias("need"), F.when(F.col("w") < WORDS, -1).otherwise(F.floor(F.log2(F.col("n")))).cast("int").alias("part")), "item-shingles")
    sketch = sized.select("part", F.explode(F.slice("hs", F.lit(1), (F.col("n") - F.col("need") + 1).cast("int"))).alias("h"), "item", "need")
    n_sketch, n_all = sketch.count(), sized.agg(F.sum("n")).first()[0] or 0
    if not n_sketch:
        kind = items.schema[item_id].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind[1]}, {item_id} {kind[0]}, n_shingles long, n_found long, containment double")
    # by partition: the least words a document must have, and the highest hash worth a lookup
    parts = sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("h").alias("top")).collect()  # at most 65 rows
    # a row of words each: what generates rows isn't repeated in the filters above it, so that a text is split once
    base = docs.select(F.col(id_col).alias("id"), F.explode(F.array(_words(text_col))).alias("w"))
    places = F.greatest(F.size("w") - WORDS + 1, F.lit(1))
    top = F.lit(None).cast("long")
    for p in sorted(parts, key=lambda p: p["need"]):
        able = F.size("w") < WORDS if p["part"] < 0 else (places >= p["need"]) & (F.size("w") >= WORDS)
        top = F.when(able, F.greatest(top, F.lit(p["top"]))).otherwise(top)
    row = base.select("id", "w", places.alias("places"), top.alias("top")).filter("top is not null")
    row = row.select("id", "w", "places", "top", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i")).filter(F.get("w", F.col("i")) != "")
    probes = row.select("id", "places", "top", F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(WORDS)]).alias("h")).filter("h <= top")
    met = _joined(probes, sketch.select("h", "item", "need"), n_sketch).filter("places >= need")
    candidates = saved(met.select("id", "item").distinct(), "leak-candidates")
    # verification: all shingles of the candidates, against all shingles of their items
    full = sized.select("item", F.explode("hs").alias("h"))
    again = docs.join(candidates.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    hits = _joined(shingles(again, id_col, text_col), full, n_all).select("id", "item", "h").distinct()
    counted = hits.groupBy("id", "item").agg(F.count(F.lit(1)).alias("n_found"))
    found = counted.join(candidates, ["id", "item"], "left_semi").join(sized.select("item", "n", "need"), "item").filter("n_found >= need")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item; rows with a null id stay."""
    found = contaminated(docs, items, id_col, text_col).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(found, docs[id_col] == F.col("__gone"), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
t AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM t GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM s JOIN t USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found >= ceil(n_shingles * 0.8 - 1e-9)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE = {"op3_decontaminate": OP3_SQL}
