"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

Vectors are integers. The index cuts them into shards of bounded size; in a shard, the postings
(vector, value) of each dimension lie in segments by impact level, the bit length of |value|: highest level first,
dimension by dimension. A search takes a block of queries through the segments in that order and adds each
posting's contributions to accumulators. What a vector
still has to give is bounded by Cauchy and Schwarz: |query| times the norm of its postings in
levels not yet taken. After each level, vectors that no query of the block can want any more are dropped from
all further segments. The search of a shard stops only on proof, when few vectors have an upper bound
that reaches the k-th largest lower bound of their query; every such vector, and so every possible
member of the result, ties included, is scored again exactly in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table

SHARD, QUERY_BLOCK, STEP = 8192, 2048, 32
INDEX = "shard long, ids binary, dims int, levels binary, slots binary, places binary, amounts binary"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """`id` and `v` = floor(scale * x) of each component, as a double; vectors that are null or hold null or non-finite components are left out."""
    ok = F.col(vector_col).isNotNull() & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return df.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(vectors: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows of int64; short vectors are filled up with zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), dims or 0)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def _build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    x, ids = _matrix(group["v"]), group["id"].to_numpy()
    slot, dim = np.nonzero(x)
    value = x[slot, dim]
    level = np.frexp(np.abs(value).astype(np.float64))[1].astype(np.int16)
    order = np.lexsort((slot, dim, -level))
    blob = lambda a: pa.array([a.tobytes()], pa.binary())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "ids": blob(ids.astype("<i8")), "dims": pa.array([x.shape[1]], pa.int32()), "levels": blob(level[order].astype("<i2")), "slots": blob(slot[order].astype("<i4")), "places": blob(dim[order].astype("<i4")), "amounts": blob(value[order].astype("<i8"))})


def build_index(vectors: DataFrame, shard_size: int = SHARD) -> tuple[DataFrame, int]:
    """The stored index of (`id`, `v`) and its number of shards; a shard has about `shard_size` vectors, dealt by hash of all columns."""
    shards = max(1, math.ceil(vectors.count() / shard_size))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)))
    return saved(dealt.groupBy("shard").applyInArrow(_build, INDEX), "impact-index"), shards


def _search_shard(ids: np.ndarray, n_dims: int, level: np.ndarray, slot: np.ndarray, dim: np.ndarray, value: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact (query row, slot, score) of the k best of each query in this shard, ties by id; segments come by descending level."""
    n = len(ids)
    weight = value.astype(np.float64)
    norms2 = np.bincount(slot, weights=weight**2, minlength=n)
    cuts = [0, *(np.flatnonzero(np.diff(level)) + 1), len(level)] if len(level) else [0]
    left_after, left = [], norms2.copy()  # for each level, what is left of the squared norms
    for a, b in zip(cuts, cuts[1:], strict=False):
        left = left - np.bincount(slot[a:b], weights=weight[a:b] ** 2, minlength=n)
        left_after.append(left)
    found = []
    for lo in range(0, len(queries), STEP):
        q, qi = queries[lo : lo + STEP].astype(np.float64), q_ids[lo : lo + STEP]
        q_norm = np.sqrt((q**2).sum(1))
        own = ids[:, None] == qi[None, :]
        acc, open_ = np.zeros((n, len(q))), np.ones(n, bool)
        possible = ~own
        for done, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            mine = np.arange(a, b) if open_.all() else a + np.flatnonzero(open_[slot[a:b]])
            edges = np.flatnonzero(np.diff(dim[mine], prepend=-1, append=-1))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # a segment: a dimension at this level
                at = mine[s:e]
                acc[slot[at]] += weight[at, None] * q[None, :, dim[at[0]]]
            last = done == len(cuts) - 2
            rest = np.zeros(n) if last else np.sqrt(np.maximum(left_after[done], 0) + 1e-9 * norms2)
            bound = rest[:, None] * q_norm[None, :] + 1e-9 * (np.abs(acc) + 1)
            low = np.where(own | ~open_[:, None], -np.inf, acc - bound)
            kth = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(q), -np.inf)
            possible = (acc + bound >= kth[None, :]) & ~own & open_[:, None]
            open_ = possible.any(1)
            if possible.sum() <= 4 * k * len(q):  # the proof leaves few; score those exactly
                break
        s, r = np.nonzero(possible)
        # the exact vectors of the slots that are left, from their postings
        left_slots, row = np.unique(s, return_inverse=True)
        x = np.zeros((len(left_slots), n_dims), np.int64)
        at = np.searchsorted(left_slots, slot)
        here = np.flatnonzero((at < len(left_slots)) & (left_slots[np.minimum(at, max(len(left_slots) - 1, 0))] == slot)) if len(left_slots) else np.zeros(0, np.int64)
        x[at[here], dim[here]] = value[here]
        exact, score = queries[lo : lo + STEP], np.empty(len(r), np.int64)
        for p in range(0, len(r), 1 << 16):
            score[p : p + (1 << 16)] = np.einsum("ij,ij->i", exact[r[p : p + (1 << 16)]], x[row[p : p + (1 << 16)]])
        order = np.lexsort((ids[s], -score, r))
        r, s, score = r[order], s[order], score[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        found.append((r[keep] + lo, s[keep], score[keep]))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [(), (), ()]))


def _search(k: int):
    def search(key: tuple[pa.Scalar, ...], index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"q": [np.zeros(0, np.int64)], "query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0, np.int64)]}
        for i in range(index.num_rows if queries.num_rows else 0):
            get = lambda c, t: np.frombuffer(index[c][i].as_py(), t)  # noqa: E731, B023
            ids, dims = get("ids", "<i8"), index["dims"][i].as_py()
            q = _matrix(queries["v"], dims)
            r, s, score = _search_shard(ids, dims, get("levels", "<i2"), get("slots", "<i4"), get("places", "<i4"), get("amounts", "<i8"), queries["id"].to_numpy(), q[:, :dims], k)
            for name, a in (("q", queries["q"].to_numpy()[r]), ("query_id", queries["id"].to_numpy()[r]), ("vec_id", ids[s]), ("score", score)):
                out[name].append(a)
        return pa.table({n: pa.array(np.concatenate(a), pa.int64()) for n, a in out.items()})

    return search


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best of the index for each row of `queries` (`id`, `v`): query_id, rank, vec_id, score.

    Candidates are all indexed vectors but those with the query's own id; ties go to the smaller id;
    a query has fewer rows if there are fewer candidates. Vectors of other lengths count as filled up
    with zeros; scores must fit 64 bits. Query rows equal in id and vector give one result; rows that repeat an id with
    another vector are queries of their own, each with its ranks; repeated indexed rows
    are candidates one by one. An empty table of queries or vectors gives no rows. Queries go to the shards in blocks, and each task holds a shard and a block.
    """
    queries = queries.select("id", "v", F.xxhash64("id", "v").alias("q")).distinct()
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    q = queries.withColumn("block", F.pmod("q", F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    grid = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    near = grid.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(_search(k), "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose vec_id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index, shards = build_index(vectors)
    return search_index(index, shards, vectors.filter(F.col("id") % 50 == 0))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.v AS qv, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_topk_search": op2_topk_search}
ORACLE = {"op2_topk_search": OP2_SQL}
