"""Join of documents by the Jaccard similarity of their word 5-grams, pruned by Bayes.

1. Each text becomes its set of 5-gram hashes. Documents with equal sets are one class of copies; only
   the smallest id of a class goes on.
2. MinHash signatures are banded (32 bands of 5). Bands that meet link their documents to the
   smallest id there: the components of these links hold every candidate pair. At a similarity of
   0.8, a pair meets in no band with a probability of (1 - 0.8**5)**32 = 3e-6.
3. Components are compared in tiles of at most 1024 x 1024 documents; a larger component is many
   tiles, for as many tasks. A large component that hangs together by chains, so that its bands have fewer pairs than
   itself, is compared band by band instead, each pair in the first band that it shares. In a tile, signatures are compared 32 values at a time. After each step
   a pair goes if the posterior probability that its similarity reaches the threshold, given its
   matches so far and a uniform prior, is below `tolerance`. All pairs left are verified exactly.
4. A tile gives, for each document, its number of links and a root among the documents that links
   of the tile reach; pairs are never emitted. Components of the roots are the result's classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import saved, spread_join, spread_split, table
from .shingles import WORDS, mixed, shingle_set

BANDS, ROWS, STEP, TILE = 32, 5, 32, 1024
HASHES = BANDS * ROWS
THRESHOLD, TOLERANCE = 0.8, 1e-6


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    h = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:HASHES] | np.uint32(1), low[HASHES:]


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes (not empty)."""
    mul, mask = _family()
    h, out = (hashes >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(h), 1024):
        z = (h[i : i + 1024, None] ^ mask) * mul
        z ^= z >> np.uint32(15)
        least = z.min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for row in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = mixed(h ^ (row * np.uint64(0xD6E8FEB86659FD93)))
    return h.view(np.int64)


_SKETCH = "id long, n int, k1 long, k2 long, bands array<long>"


def _sum(h: np.ndarray) -> int:
    return int(h.sum().view(np.int64))


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, words)
                n.append(len(h))
                k1.append(_sum(h) if len(h) else 0)
                k2.append(_sum(mixed(h)) if len(h) else 0)
                bands.append(_bands(signature(h)) if len(h) else None)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "bands"])

    return run


def _load(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sets = [shingle_set(t, words) for t in col["text"].to_pylist()]
            own = [n for n in batch.schema.names if n != "text"]
            mine = [i for i, (h, k) in enumerate(zip(sets, col["k1"].to_pylist(), strict=True)) if len(h) and _sum(h) == k]
            sets = [sets[i] for i in mine]
            cols = [*(col[n].take(pa.array(mine, pa.int64())) for n in own), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([signature(h).tobytes() for h in sets], pa.binary())]
            yield pa.record_batch(cols, names=[*own, "hashes", "sig"])

    return run


def _at_most(m: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m + 1))


@lru_cache(maxsize=8)
def fewest_matches(threshold: float, tolerance: float, step: int = STEP) -> tuple[tuple[int, int], ...]:
    """(n, m): after n values, pairs with fewer than m matches go.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1); its tail beyond t
    is the probability that a Binomial(n + 1, t) is at most m.
    """
    out = []
    for n in range(step, HASHES + 1, step):
        m = 0
        while m <= n and _at_most(m, n + 1, threshold) < tolerance:
            m += 1
        out.append((n, m))
    return tuple(out)


def _survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that no step prunes (i < j if they are one)."""
    dense, pairs, done = np.zeros((len(a), len(b)), np.int16), None, 0
    for n, m in fewest_matches(threshold, tolerance):
        if pairs is None:
            for k in range(done, n):
                dense += a[:, k, None] == b[None, :, k]
            ok = dense >= m
            if same:
                ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            if ok.mean() < 0.05 or n == HASHES:
                pairs = np.nonzero(ok)
                counts = dense[pairs].astype(np.int64)
        else:
            i, j = pairs
            counts = counts + np.concatenate([(a[i[s : s + 65536], done:n] == b[j[s : s + 65536], done:n]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
            keep = counts >= m
            pairs, counts = (i[keep], j[keep]), counts[keep]
        done = n
    return pairs


def _first_band(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band that each pair of signatures shares; a number beyond all bands if none."""
    out = np.full(len(i), BANDS)
    for s in range(0, len(i), 16384):
        same = (a[i[s : s + 16384]] == b[j[s : s + 16384]]).reshape(-1, BANDS, ROWS).all(2)
        out[s : s + 16384] = np.where(same.any(1), same.argmax(1), BANDS)
    return out


def _overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact size of the intersection of each pair."""
    if not len(i):
        return np.zeros(0, np.int64)
    ra, ia = np.unique(i, return_inverse=True)
    rb, jb = np.unique(j, return_inverse=True)
    flat_a, flat_b = np.concatenate([sets_a[k] for k in ra]), np.concatenate([sets_b[k] for k in rb])
    common = np.intersect1d(flat_a, flat_b)
    mean = (len(flat_a) / len(ra) + len(flat_b) / len(rb)) / 2
    if len(ra) * len(rb) * len(common) / 1e10 > len(i) * (6e-6 + mean * 3e-8):
        return np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)

    # many pairs over few shingles: a product of membership matrices, in slices of columns
    def members(flat, rows, sets):
        owner = np.repeat(np.arange(len(rows)), [len(sets[k]) for k in rows])
        at = np.searchsorted(common, flat)
        ok = (at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == flat) if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        return owner[ok][order], at[ok][order]

    (oa, ca), (ob, cb) = members(flat_a, ra, sets_a), members(flat_b, rb, sets_b)
    total = np.zeros((len(ra), len(rb)), np.float32)
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        xa, xb = np.zeros((len(ra), width), np.float32), np.zeros((len(rb), width), np.float32)
        s, e = np.searchsorted(ca, [lo, lo + width])
        xa[oa[s:e], ca[s:e] - lo] = 1
        s, e = np.searchsorted(cb, [lo, lo + width])
        xb[ob[s:e], cb[s:e] - lo] = 1
        total += xa @ xb.T
    return total[ia, jb].astype(np.int64)


def _roots(n: int, i: list[int], j: list[int]) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(i, j, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _compare(threshold: float, tolerance: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tile_a, tile_b = key[1].as_py(), key[2].as_py()
        component, ids, tile, band = (group[c].to_numpy() for c in ("component", "id", "tile", "band"))
        hashes = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(len(ids), HASHES)
        out_id, out_links, out_root = [], [], []
        order = np.lexsort((ids, component, band))
        cuts = np.flatnonzero((np.diff(component[order]) != 0) | (np.diff(band[order]) != 0)) + 1
        for part in np.split(order, cuts):
            part = part[np.unique(ids[part], return_index=True)[1]]  # rows that repeat a document
            ra = part[tile[part] == tile_a]
            rb = ra if tile_a == tile_b else part[tile[part] == tile_b]
            if not len(ra) or not len(rb):
                continue
            i, j = _survivors(sigs[ra], sigs[rb], threshold, tolerance, tile_a == tile_b)
            if (b := band[part[0]]) >= 0:  # a pair of a band group is compared in the first band that it shares
                keep = _first_band(sigs[ra], sigs[rb], i, j) == b
                i, j = i[keep], j[keep]
            sa, sb = [hashes[k] for k in ra], [hashes[k] for k in rb]
            size_a, size_b = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
            both = _overlaps(sa, sb, i, j)
            ok = both >= threshold * (size_a[i] + size_b[j] - both)
            i, j = ra[i[ok]], rb[j[ok]]
            if not len(i):
                continue
            used = np.unique(np.concatenate([i, j]))
            used = used[np.argsort(ids[used], kind="stable")]  # the root is the smallest id
            place = {k: x for x, k in enumerate(used.tolist())}
            links = np.bincount(np.concatenate([i, j]), minlength=len(ids))[used]
            roots = _roots(len(used), [place[k] for k in i.tolist()], [place[k] for k in j.tolist()])
            out_id.append(ids[used])
            out_links.append(links)
            out_root.append(ids[used][roots])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"id": cat(out_id), "links": cat(out_links), "root": cat(out_root)})

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, words: int = WORDS) -> DataFrame:
    """Classes of documents whose sets of word 5-grams have a Jaccard similarity of at least `threshold`.

    One row for each row of `docs`: id, `class_id` (the smallest id of its component of links),
    `copy_of` (the smallest id with the same set), `n_copies` (rows with the same set, itself too) and
    `n_links` (other sets similar to its own). Words are runs of letters and digits in lower case; a text of one to four
    words is one shingle; null texts and texts without words have no links and are classes of their own.
    An id stands for one document: rows that repeat an id have one class, and where their texts differ, one of them, by
    the smallest hash, is compared. A null id is a class of its own (null). Texts are read whole.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = saved(rows.mapInArrow(_sketch(words), _SKETCH), "ngram-sketches")
    known = (F.col("n") > 0) & F.col("id").isNotNull()
    with_id = sketch.filter(known)
    copies = saved(with_id.groupBy("k1", "k2").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies")), "ngram-copies")
    # of an id that rows of several texts repeat, one text stands for it
    reps = copies.groupBy(F.col("copy_of").alias("id")).agg(F.min("k1").alias("k1"))
    bands = with_id.join(reps, ["id", "k1"], "left_semi").select("id", F.posexplode("bands").alias("b", "band")).distinct()
    least = bands.groupBy("band").agg(F.min("id").alias("m"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).filter("m < most").select("band", "m", "n")
    met = saved(spread_join(bands, saved(least.withColumn("size", F.col("n")), "ngram-bands"), "band", BANDS * copies.count()), "ngram-members")
    candidates = saved(connected_components(met.filter("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))).withColumnRenamed("v", "id"), "ngram-components")

    total = candidates.count()
    placed = _placed(candidates, met, total).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).join(reps, "id")
    kept = "id long, component long, band int, tile int, tiles int, k1 long"
    loaded = placed.join(rows.hint("merge"), "id").select(*(x.split()[0] for x in kept.split(", ")), "text").mapInArrow(_load(words), f"{kept}, hashes binary, sig binary")
    # small components and bands share groups; a large one meets itself tile by tile
    groups = max(1, math.ceil(total / TILE))
    spread = loaded.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    alone = F.concat(F.when(F.col("band") < 0, "c").otherwise("b"), F.col("component").cast("string"))
    keyed = spread.select(
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(groups)).cast("string")).otherwise(alone).alias("g"),
        F.least("tile", "with").alias("ta"), F.greatest("tile", "with").alias("tb"), "component", "band", "id", "tile", "hashes", "sig",
    )
    found = saved(keyed.groupBy("g", "ta", "tb").applyInArrow(_compare(threshold, tolerance), "id long, links long, root long"), "ngram-links")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    classes = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = links.join(classes.withColumnRenamed("v", "id"), "id").select(F.col("id").alias("copy_of"), "n_links", "component")
    # copies learn of their class one by one, the rows with a set from their copies: no group gathers
    judged = saved(copies.join(linked, "copy_of", "left").withColumn("n", F.col("n_copies")), "ngram-classes")
    out = spread_join(with_id.select("id", "k1", "k2"), judged, ["k1", "k2"], sketch.count())
    out = out.select(F.col("id").alias(id_col), F.coalesce("component", "copy_of").alias("class_id"), "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = sketch.filter(~F.coalesce(known, F.lit(False)))
    return out.unionByName(alone.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")))


def _placed(candidates: DataFrame, met: DataFrame, total: int) -> DataFrame:
    """`id`, `component`, `band`, `size`: where every candidate is compared, in its component (band -1) or in all its bands."""
    size = saved(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("n", F.col("size")), "ngram-sizes")
    whole = F.lit(-1).alias("band")
    large = size.filter(F.col("size") > TILE).select("component", "size")
    if large.isEmpty():
        return spread_join(candidates, size, "component", total).select("id", "component", whole, "size")
    # a component held together by chains has bands with fewer pairs than itself
    bands = met.filter("id = m").select("id", F.col("size").alias("of_band"))
    work = candidates.join(bands, "id").join(large, "component").groupBy("component", "size").agg(F.sum(F.col("of_band") * F.col("of_band").cast("double")).alias("work"))
    loose = work.filter(F.col("work") < F.col("size") * F.col("size").cast("double")).select("component", F.lit(True).alias("loose"))
    sized = saved(size.join(loose, "component", "left").select("component", "size", "n", F.coalesce("loose", F.lit(False)).alias("loose")), "ngram-sizes")
    told = saved(spread_join(candidates, sized, "component", total), "ngram-placed")
    by_band = met.join(told.filter("loose").select("id"), "id").select("id", F.col("band").alias("component"), F.col("b").alias("band"), "size")
    return told.filter("not loose").select("id", "component", whole, "size").unionByName(by_band)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are similar to one with a smaller id: one of each class stays, with all its columns.

    Rows with a null id stay; of rows that repeat an id, one stays: that with the smallest hash of all its columns.
    """
    found = similar_documents(docs, id_col, text_col, threshold).filter(F.col(id_col).isNotNull())
    ids = saved(found.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("class_id") != F.col(id_col)).alias("__gone")), "ngram-ids")
    rows = docs.withColumn("__id", F.col(id_col).cast("long"))
    total = ids.agg(F.sum("__n")).first()[0] or 0
    matched, others = spread_split(rows.filter("__id is not null"), ids.filter("__gone or __n > 1"), "__id", total, "__n")
    # equal rows combine in the map tasks; then the smallest hash of an id decides
    hashed = matched.filter(~F.col("__gone")).withColumn("__h", F.xxhash64(F.to_json(F.struct(*docs.columns)))).dropDuplicates(["__id", "__h"])
    one = hashed.join(hashed.groupBy("__id").agg(F.min("__h").alias("__h")), ["__id", "__h"], "left_semi")
    return others.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity classes and links of all documents."""
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
