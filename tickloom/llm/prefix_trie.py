"""The trie of conversation prefixes, by range minima over sorted longest common prefixes.

A turn is a 16-byte key of its role and text. Conversations with the same turns are one sequence; sequences are sorted, and the
longest common prefix (LCP) of neighbours is all that the trie needs: a node of depth d is a run of sequences between which no
LCP is below d. A sparse table holds the minima of all runs of 2**k LCPs, and every candidate prefix finds the left and the
right end of its run by binary search in it, on its own: no stack, no order among candidates, so numpy does all of a block at
once. Members, leaves and tokens of a run are then differences of running sums, its smallest member another range minimum.

Sorted sequences are cut into blocks of bounded size, one a task. The LCP of two neighbouring blocks and the smallest LCP of a
block are two integers a block; a sparse table over those finds the block in which a prefix that spans blocks begins. Such
prefixes are few (those of a block's first and last sequence): their pieces are summed by DataFrame operations, and every block
then writes the nodes that begin in it. A first turn that all conversations share is so many pieces, not a group of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, saved, table

#: Turns of a block, on average: some 10 MB of keys.
BLOCK_TURNS = 250_000
#: Characters of ids that are joined before a node's ids meet in one place to be hashed.
CHUNK = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PIECES = "block long, at long, owner long, depth long, owned boolean, beyond boolean, conv_id long, n_convs long, n_children long, n_leaves long, closed long, chars long"


# -- range minima --------------------------------------------------------------------------------


class RangeMin:
    """Minima of all runs of 2**k values; every search takes one step a level, for all candidates at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        k = 1
        while 2 * k <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest r >= at with no value of (at, r] below `least`."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) < n
            fits[fits] = self.levels[k][at[fits] + 1] >= least[fits]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest l <= at with no value of (l, at] below `least`."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at >= 1 << k
            fits[fits] = self.levels[k][at[fits] - (1 << k) + 1] >= least[fits]
            at[fits] -= 1 << k
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The smallest value of [first, last], from two runs that cover it."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.levels[k][first[on]], self.levels[k][last[on] - (1 << int(k)) + 1])
        return out


# -- one block -----------------------------------------------------------------------------------


class Block:
    """The prefixes of a block's sorted, distinct sequences, numbered by (first sequence, depth): depth-first order.

    `before` and `after` are the LCPs with the neighbouring blocks, -1 at the ends. Prefixes of the first sequence up to depth
    `before` began in an earlier block; those of the last sequence up to `after` go on in the next.
    """

    def __init__(self, rows: pa.Table, before: int, after: int):
        rows = rows.sort_by("pos").combine_chunks()
        turns = rows.column("turns").combine_chunks()
        turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
        size = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = turns.flatten()
        keys = np.frombuffer(b"".join(flat.field("key").to_pylist()), np.uint64).reshape(-1, 2)
        chars = flat.field("chars").to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(size)])
        members, smallest = (rows.column(c).to_numpy() for c in ("n", "first_id"))
        n = len(size)

        lcp = np.full(n, -1, np.int64)  # of each sequence with the one before
        shared = np.minimum(size[1:], size[:-1])
        pair = np.repeat(np.arange(1, n), shared)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(shared) - shared, shared)
        differ = (keys[start[pair - 1] + k] != keys[start[pair] + k]).any(axis=1) if len(pair) else np.zeros(0, bool)
        lcp[1:] = shared
        np.minimum.at(lcp, pair[differ], k[differ])

        count = size - lcp
        self.begin = np.concatenate([[0], np.cumsum(count)])  # of each sequence's prefixes
        self.row = np.repeat(np.arange(n), count)
        self.depth = np.arange(len(self.row)) - self.begin[self.row] + lcp[self.row] + 1
        minima = RangeMin(lcp)
        last = minima.right(self.row, self.depth)
        parent_row = minima.left(self.row, self.depth - 1)
        self.parent = np.where(self.depth > 0, self.begin[parent_row] + self.depth - 1 - (lcp[parent_row] + 1), -1)

        self.owned = (self.row > 0) | (self.depth > before)
        self.beyond = (last == n - 1) & (self.depth <= after)
        self.open = ~self.owned | self.beyond
        between = lambda sums: sums[last + 1] - sums[self.row]
        running = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.n = between(running(members))
        self.conv = RangeMin(smallest).least(self.row, last)
        leaf = np.append(lcp[1:], after) < size
        self.leaves = between(running(leaf.astype(np.int64)))
        counted = self.owned & (self.depth > 0)
        self.children = np.bincount(self.parent[counted], minlength=len(self.row)).astype(np.int64)
        self.chars = np.zeros(len(self.row), np.int64)
        deep = self.depth > 0
        self.chars[deep] = chars[start[self.row[deep]] + self.depth[deep] - 1]
        # tokens of the closed prefixes below: these follow in depth-first order
        tokens = running(np.where(self.open, 0, (self.n - 1) * self.chars))
        self.saved = tokens[self.begin[last + 1]] - tokens[:-1]
        self.full = self.depth == size[self.row]
        self.ends = rows.column("ends").to_numpy(zero_copy_only=False)


def lcp_of(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    m = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1), m), lambda x, y: x != y), F.lit(True))
    return F.when(first == 0, m).otherwise(first - 1).cast("long")


# -- ids of the conversations that end at a node ---------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, conv_id) as runs of joined ids."""
    sid, at, held, size = None, None, [], 0

    def out():
        return pa.record_batch([pa.array([sid], pa.binary()), pa.array([at], pa.int64()), pa.array([",".join(held)], pa.string())], names=["sid", "at", "ids"])

    for batch in batches:
        for s, c in zip(batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (s != sid or size > CHUNK):
                yield out()
                held, size = [], 0
            if not held:
                sid, at = s, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield out()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of joined ids as one hash for each sid; a hash holds a few bytes, however many ids it takes in."""
    sid, h = None, None

    def out(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["sid", "ends"])

    for batch in batches:
        rows = []
        for s, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if s != sid or h is None:
                rows += [(sid, h.hexdigest())] if h else []
                sid, h = s, hashlib.sha256(ids.encode())
            else:
                h.update(f",{ids}".encode())
        if rows:
            yield out(rows)
    if h:
        yield out([(sid, h.hexdigest())])


def ends_of(convs: DataFrame, partitions: int) -> DataFrame:
    """`sid` and `ends`, the SHA-256 of the ascending ids of its conversations, joined by commas.

    A hash takes its input in order, so one task hashes a sequence's ids; they come to it joined in runs, by tasks that
    share the ids of a sequence among them.
    """
    ids = convs.select("sid", "conv_id").repartitionByRange(partitions, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    runs = ids.mapInArrow(_chunks, "sid binary, at long, ids string")
    return runs.repartition(partitions, "sid").sortWithinPartitions("sid", "at").mapInArrow(_hashes, "sid binary, ends string")


# -- the trie ----------------------------------------------------------------------------------------


def prefix_trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a node: every distinct beginning of the conversations, from the root of depth 0.

    `convs` has `conv_id` (distinct, not null) and `turns`, an array of (`key`, 16 bytes; `chars`, a weight that follows from the
    key). A node is named by `conv_id`, its smallest member, and `depth`: that conversation's first `depth` turns are its
    text. `parent_conv_id` is its parent's name (null for the root), `n_convs` its members, `n_children` and `n_leaves` its children and
    the childless nodes of its subtree, `saved_tokens` the sum over its subtree of (n_convs - 1) * chars of the last turn, and
    `ends_sha256` hashes the ids of the conversations that end here. No conversations give no nodes; conversations without turns
    are members of the root. A conversation is one row, and its turns' keys fit a task; everything else is split.
    """
    spark = convs.sparkSession
    sid = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""), 256))
    convs = saved(convs.select("conv_id", "turns", sid.alias("sid")), "trie-conversations")
    total = convs.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_turns))
    distinct = convs.groupBy("sid", "turns").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_id"))
    named = distinct.join(ends_of(convs, blocks), "sid").drop("sid")
    ordered = named.repartitionByRange(blocks, "turns").sortWithinPartitions("turns")
    rows = saved(ordered.select(F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("pos"), "turns", "n", "first_id", "ends"), "trie-sorted")

    # two integers a block: its LCP with the block before, and the smallest LCP from there to its end
    edges = saved(rows.groupBy("block").agg(F.min_by("turns", "pos").alias("head"), F.max_by("turns", "pos").alias("tail")), "trie-edges")
    ids = sorted(r["block"] for r in edges.select("block").collect())
    follows = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "prev long, block long")
    pairs = edges.join(follows, "block").join(edges.select(F.col("block").alias("prev"), F.col("tail").alias("end")), "prev")
    found = {r["block"]: (r["a"], r["b"]) for r in pairs.select("block", lcp_of("end", "head").alias("a"), lcp_of("end", "tail").alias("b")).collect()}
    place = {b: i for i, b in enumerate(ids)}
    seam = [found[b][0] if b in found else -1 for b in ids] + [-1]
    lowest = np.array([found[b][1] if b in found else -1 for b in ids] or [-1], np.int64)

    def local(rows: pa.Table) -> tuple[int, Block]:
        b = rows.column("block")[0].as_py()
        return b, Block(rows, seam[place[b]], seam[place[b] + 1])

    def pieces(rows: pa.Table) -> pa.Table:
        """The part in this block of every prefix that spans blocks, under the block where the prefix begins."""
        b, x = local(rows)
        at = np.flatnonzero(x.open)
        here = np.full(len(at), place[b], np.int64)
        owner = np.where(x.owned[at], here, RangeMin(lowest).left(np.maximum(here - 1, 0), x.depth[at]))
        cols = [np.full(len(at), b), at, np.array(ids, np.int64)[owner], x.depth[at], x.owned[at], x.beyond[at], *(v[at] for v in (x.conv, x.n, x.children, x.leaves, x.saved, x.chars))]
        return pa.table(dict(zip((c.split()[0] for c in PIECES.split(", ")), cols, strict=True)))

    def nodes(rows: pa.Table, spans: pa.Table) -> pa.Table:
        """The nodes that begin in this block; `spans` has the sums of those that span blocks."""
        if not rows.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c else pa.int64()) for c in NODES.split(", ")})
        _, x = local(rows)
        at = spans.column("at").to_numpy()
        for name, c in (("conv", "conv_id"), ("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved")):
            getattr(x, name)[at] = spans.column(c).to_numpy()
        on = np.flatnonzero(x.owned)
        top = x.parent[on] < 0
        ends = np.full(len(on), NO_ENDS, object)
        ends[x.full[on]] = x.ends[x.row[on][x.full[on]]]
        cols = [x.conv[on], x.depth[on], pa.array(np.where(top, 0, x.conv[x.parent[on]]), pa.int64(), mask=top), x.n[on], x.children[on], x.leaves[on], x.saved[on], pa.array(ends, pa.string())]
        return pa.table(dict(zip((c.split()[0] for c in NODES.split(", ")), cols, strict=True)))

    part = saved(rows.groupBy("block").applyInArrow(pieces, PIECES), "trie-pieces")
    whole = ["owner", "depth"]
    sums = part.groupBy(*whole).agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")), F.max("chars").alias("chars"))
    sums = saved(sums, "trie-sums")
    # prefixes that span blocks lie in one another: in the block where one begins, every shallower one that goes on as well has it
    inner = part.join(sums.select(*whole, ((F.col("n_convs") - 1) * F.col("chars")).alias("own")), whole).withColumn("own", F.when(F.col("owned") & F.col("beyond"), F.col("own")).otherwise(0))
    deeper = Window.partitionBy("block").orderBy(F.col("depth").desc())
    inner = inner.withColumn("closed", F.col("closed") + F.when(F.col("beyond"), F.sum("own").over(deeper)).otherwise(0))
    tokens = inner.groupBy(*whole).agg(F.sum("closed").alias("saved"))
    spans = saved(part.select("block", "at", *whole).join(sums, whole).join(tokens, whole).select("block", "at", "conv_id", "n_convs", "n_children", "n_leaves", "saved"), "trie-spans")
    out = saved(rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(nodes, NODES), "trie-nodes")
    forget(convs, rows, edges, part, sums, spans)
    return out


# -- conversations -------------------------------------------------------------------------------------


def keyed_turns(messages: DataFrame) -> DataFrame:
    """`conv_id` and `turns` of every conversation, ordered by turn (null first; equal turns by key, so that any order of rows will do).

    The key of a turn is half the SHA-256 of its role and text, of which null counts as empty. Rows with a null conv_id belong to no
    conversation and have no effect; rows that repeat a turn are turns of their own. Texts are read once and do not move.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = messages.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("chars"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "chars"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def branched(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations as continuations: c begins with the first h turns of the conversation c - c % `every`, if there is one, and goes
    on with its own turns after its first h, where h is the unsigned CRC-32 of the decimal c modulo `most`.

    A beginning serves at most 2 * `every` - 1 conversations, so that no key of the join is hot.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("begin"))
    met = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    return met.select("conv_id", F.concat(F.coalesce(F.slice("begin", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


OP12_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS own FROM m GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM o),
s AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM s, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)),
q AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM q WHERE d > 0 GROUP BY ALL),
f AS (SELECT q.*, coalesce(k.n, 0) AS n_children FROM q LEFT JOIN k ON q.p = k.p),
u AS (SELECT f.p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * length(f.p[d].t) ELSE 0 END) AS saved
  FROM f, LATERAL (SELECT unnest(range(f.d + 1)) AS a) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u ON f.p = u.p LEFT JOIN f g ON f.d > 0 AND g.p = f.p[1:f.d - 1]
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each begun as the hundredth before it, as a trie of their turns."""
    return prefix_trie(branched(keyed_turns(table(spark, sf_dir, "conversations"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE = {"op12_prefix_trie": OP12_SQL}
