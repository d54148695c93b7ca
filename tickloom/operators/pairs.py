"""All pairs of strategies, and nearest vectors, in blocks: a task compares two blocks, and no pair is a row.

Strategies of equal profiles are one class, compared once and counted by its members. The work grows with the square of the number
of different profiles, as the question does; what is stored and shuffled does not, but for a row for each class and block: blocks are
packed once, and a cartesian product of them hands every task its two. The result has one row for each strategy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut

#: Classes of a block: up to 16 blocks have so many at least; none has more than about `MOST`, nor more than `ENTRIES` returns and days.
BLOCK, MOST, ENTRIES = 2048, 65_536, 8_000_000
#: Rows and columns of a matrix that is made at a time.
ROWS, COLUMNS = 64, 2048
#: The measures, and the columns that they read.
KINDS = {"corr": ["r"], "jaccard": ["days"], "similarity": ["r", "days"]}


def profiles(returns: DataFrame, trades: DataFrame) -> DataFrame:
    """`strategy_id`, `r` (returns by place) and `days` (distinct days of entry, as numbers) of every strategy."""
    r = returns.groupBy("strategy_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"]).alias("r"))
    d = trades.groupBy("strategy_id").agg(F.array_sort(F.collect_set(F.unix_date(F.to_date("entry_ts")))).alias("days"))
    return r.join(d, "strategy_id", "full")


def _padded(series: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled up with zeros, and which places hold a value."""
    n = max((len(s or ()) for s in series), default=0)
    x, m = np.zeros((len(series), n)), np.zeros((len(series), n))
    for i, s in enumerate(series):
        v = np.array(s or (), np.float64)
        ok = np.isfinite(v)
        x[i, : len(v)], m[i, : len(v)] = np.where(ok, v, 0.0), ok
    return x, m


def correlation_matrix(a: list, b: list) -> np.ndarray:
    """Absolute correlations over the places that both series have; NaN with fewer than 3, or where one does not vary."""
    (x, mx), (y, my) = _padded(a), _padded(b)
    w = min(x.shape[1], y.shape[1])
    x, mx, y, my = x[:, :w], mx[:, :w], y[:, :w], my[:, :w]
    n = mx @ my.T
    with np.errstate(all="ignore"):
        ex, ey = x @ my.T / n, mx @ y.T / n
        vx, vy = (x * x) @ my.T / n - ex * ex, mx @ (y * y).T / n - ey * ey
        c = (x @ y.T / n - ex * ey) / np.sqrt(vx * vy)
    return np.where((n >= 3) & (vx > 1e-18) & (vy > 1e-18), np.abs(c), np.nan)


def jaccard_matrix(a: list, b: list) -> np.ndarray:
    """Jaccard similarities of sets; NaN where they share nothing."""
    flat = [np.array(s or (), np.int64) for s in (*a, *b)]
    known = np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.int64)
    m = np.zeros((len(flat), len(known)), np.float32)
    for i, s in enumerate(flat):
        m[i, np.searchsorted(known, s)] = 1
    common = (m[: len(a)] @ m[len(a) :].T).astype(np.float64)
    size = m.sum(1, dtype=np.float64)
    return np.where(common > 0, common / np.maximum(size[: len(a), None] + size[None, len(a) :] - common, 1), np.nan)


def similarity_matrix(ra: list, da: list, rb: list, db: list, weight: float = 0.3) -> np.ndarray:
    """(1 - weight) of the correlation plus weight of the Jaccard similarity of days, to 9 digits; what is missing counts 0."""
    return np.round((1 - weight) * np.nan_to_num(correlation_matrix(ra, rb)) + weight * np.nan_to_num(jaccard_matrix(da, db)) + 3e-11, 9)


def _packed(kind: str):
    """A task's function: its classes become one row, columns as bytes, by length of series and id."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        ids, out = table["first"].to_numpy(), {}
        lists = {c: table[c].combine_chunks() for c in KINDS[kind]}
        sizes = {c: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c, x in lists.items()}
        order = np.lexsort((ids, sizes["r"])) if "r" in sizes else np.argsort(ids)
        for c, x in lists.items():
            out[c] = x.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype(np.float64 if c == "r" else np.int64)
            out[f"{c}_n"] = sizes[c][order]
        out |= {"first": ids[order], "n": table["n"].to_numpy()[order]}
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([out[c].tobytes()], pa.binary()) for c in _columns(kind))], names=["tile", *_columns(kind)])

    return run


def _columns(kind: str) -> list[str]:
    return ["first", "n", *(f"{c}{x}" for c in KINDS[kind] for x in ("", "_n"))]


class _Block:
    """Classes side by side: ids, counts of members, returns and days one after the other."""

    def __init__(self, row: dict[str, bytes]):
        of = lambda c, t=np.int64: np.frombuffer(row[c], t)
        self.ids, self.n = of("first"), of("n")
        self.weight = self.n.astype(np.float64)
        if "r" in row:
            self.length, self.r = of("r_n"), of("r", np.float64)
            self.begin = np.cumsum(self.length) - self.length
            self.gaps = np.bincount(np.repeat(np.arange(len(self.ids)), self.length)[~np.isfinite(self.r)], minlength=len(self.ids)) > 0
        if "days" in row:
            self.size, self.day = of("days_n"), of("days")
            self.end = np.cumsum(self.size)
        self.pairs, self.total = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        self.most, self.partner = np.full(len(self.ids), -1.0), np.zeros(len(self.ids), np.int64)
        self.own = np.full(len(self.ids), -1.0)

    def by_id(self, where: np.ndarray) -> np.ndarray:
        x = np.flatnonzero(where)
        return x[np.argsort(self.ids[x], kind="stable")]

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among `rows`, and days."""
        k = self.size[rows]
        return np.repeat(np.arange(len(rows)), k), self.day[_ranges(self.end[rows] - k, k)]

    def standard(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `n` returns with mean 0 and norm 1, and which rows vary."""
        x = self.r[self.begin[rows, None] + np.arange(n)]
        x -= x.mean(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        varies = norm > 1e-9 * math.sqrt(n)
        return x / np.where(varies, norm, 1.0)[:, None], varies

    def series(self, rows: np.ndarray) -> list[list]:
        return [self.r[self.begin[i] : self.begin[i] + self.length[i]].tolist() for i in rows]

    def see(self, rows: np.ndarray, best: np.ndarray, partner: np.ndarray) -> None:
        """Take a partner where it is more alike, or as much and its id is smaller."""
        better = (best > self.most[rows]) | ((best == self.most[rows]) & (best >= 0) & (partner < self.partner[rows]))
        to = rows[better]
        self.most[to], self.partner[to] = best[better], partner[better]

    def table(self) -> pa.RecordBatch:
        seen, own = self.most < 0, self.own < 0
        cols = [pa.array(self.ids), pa.array(np.rint(self.pairs).astype(np.int64)), pa.array(self.total / 1e9), pa.array(self.most / 1e9, mask=seen), pa.array(self.partner, mask=seen), pa.array(self.own / 1e9, mask=own)]
        return pa.record_batch(cols, names=["first", "pairs", "total", "most", "partner", "own"])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of ranges of `n` from `start`, one range after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _parts(a: _Block, b: _Block) -> Iterator[tuple]:
    """Rows and columns, by id, that cover all pairs once, with how their correlations are found: from standard scores, as a whole, or not at all."""
    whole_a, whole_b = ~a.gaps, ~b.gaps
    for n in np.union1d(a.length[whole_a], b.length[whole_b]).tolist():
        for wa, wb in (((a.length == n), (b.length >= n)), ((a.length > n), (b.length == n))):
            rows, cols = a.by_id(wa & whole_a), b.by_id(wb & whole_b)
            if n < 3:
                yield rows, cols, None
            elif len(rows) and len(cols):
                (x, vx), (y, vy) = a.standard(rows, n), b.standard(cols, n)
                yield rows[vx], cols[vy], (x[vx], y[vy])
                yield rows[vx], cols[~vy], None
                yield rows[~vx], cols, None
    yield a.by_id(a.gaps), b.by_id(whole_b | b.gaps), "whole"
    yield a.by_id(whole_a), b.by_id(b.gaps), "whole"


def _common(a: _Block, rows: np.ndarray, begins: np.ndarray, places: np.ndarray, first: int, width: int) -> np.ndarray:
    """How many days each row shares with each column, by the columns' places of every day from `first` on."""
    row, day = a.entries(rows)
    at = day - first
    known = (at >= 0) & (at < len(begins) - 1)
    row, at = row[known], at[known]
    k = begins[at + 1] - begins[at]
    return np.bincount(np.repeat(row * width, k) + places[_ranges(begins[at], k)], minlength=len(rows) * width).reshape(len(rows), width)


def _places(b: _Block, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    place, day = b.entries(cols)
    if not len(day):
        return np.zeros(1, np.int64), place, 0
    order, first = np.argsort(day, kind="stable"), int(day.min())
    return np.concatenate([[0], np.cumsum(np.bincount(day - first))]), place[order], first


def _compare(kind: str, a: _Block, b: _Block) -> None:
    """Note in both blocks what their pairs say; values are whole numbers of 1e-9, -1 where a pair lacks the measure. A block with itself is seen from its rows."""
    parts = _parts(a, b) if kind != "jaccard" else [(a.by_id(a.n > 0), b.by_id(b.n > 0), None)]
    share = 1e9 if kind == "corr" else 0.7e9
    for all_rows, all_cols, how in parts:
        if not len(all_rows) or not len(all_cols) or (kind == "corr" and how is None):
            continue
        for c in range(0, len(all_cols), COLUMNS):
            cols = all_cols[c : c + COLUMNS]
            days = _places(b, cols) if kind != "corr" else None
            y = (how[1][c : c + COLUMNS] * share).T.copy() if isinstance(how, tuple) else None
            for r in range(0, len(all_rows), ROWS):
                rows = all_rows[r : r + ROWS]
                there = None  # 1 where a pair has the measure, if not all have
                if y is not None:
                    m = how[0][r : r + ROWS] @ y
                    np.abs(m, out=m)
                elif how == "whole":
                    m = correlation_matrix(a.series(rows), b.series(cols)) * share
                    there = (~np.isnan(m)).astype(np.float64)
                    np.nan_to_num(m, copy=False)
                if days is not None:
                    common = _common(a, rows, *days, len(cols)).astype(np.float64)
                    either = np.maximum(a.size[rows], 1.0)[:, None] + b.size[cols].astype(np.float64)
                    either -= common
                    if y is None:
                        shared = np.minimum(common, 1.0)
                        there = shared if there is None else np.maximum(there, shared, out=there)
                    common /= either
                    common *= 1e9 if kind == "jaccard" else 0.3e9
                    m = common if how is None else np.add(m, common, out=m)
                m += 0.03
                np.rint(m, out=m)
                if a is b:
                    _, at, to = np.intersect1d(rows, cols, return_indices=True)
                    there = np.ones(m.shape) if there is None else there
                    a.own[rows[at]] = np.where(there[at, to] > 0, m[at, to], -1.0)
                    there[at, to] = m[at, to] = 0.0
                _note(a, b, rows, cols, m, there)


def _note(a: _Block, b: _Block, rows: np.ndarray, cols: np.ndarray, m: np.ndarray, there: np.ndarray | None) -> None:
    """Add a matrix to what its rows and, of two blocks, its columns have seen; `m` is 0 where a pair is not there."""
    wa, wb = a.weight[rows], b.weight[cols]
    a.pairs[rows] += wb.sum() if there is None else there @ wb
    a.total[rows] += m @ wb
    if a is not b:
        b.pairs[cols] += wa.sum() if there is None else wa @ there
        b.total[cols] += wa @ m
    if there is not None:
        m += there
        m -= 1.0
    best = m.argmax(1)  # of equals the smallest id
    a.see(rows, m[np.arange(len(rows)), best], b.ids[cols[best]])
    if a is not b:
        top = m.max(0)
        near = np.flatnonzero((top >= b.most[cols]) & (top >= 0))
        b.see(cols[near], top[near], a.ids[rows[m[:, near].argmax(0)]])


def _summarise(kind: str):
    """A task's function: for each two blocks, what the classes of each see in the other."""

    def run(batches):
        names = _columns(kind)
        for batch in batches:
            for row in batch.to_pylist():
                a = _Block({c: row[c] for c in names})
                b = a if row["tile"] == row["__tile"] else _Block({c: row[f"__{c}"] for c in names})
                _compare(kind, a, b)
                yield a.table()
                if a is not b:
                    yield b.table()

    return run


def pair_summary(profiles: DataFrame, kind: str) -> DataFrame:
    """Over all pairs of strategies that have the measure: `pairs`, `mean`, `most` and `partner` (the most alike) of each strategy."""
    by = KINDS[kind]
    rows = cut(profiles.select("strategy_id", *by), "profiles")
    classes = cut(rows.groupBy(*by).agg(F.min("strategy_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    count, entries = classes.agg(F.count(F.lit(1)), F.sum(sum((F.greatest(F.size(c), F.lit(0)).cast("long") for c in by), F.lit(0)))).first()
    tiles = max(1, math.ceil(count / MOST), math.ceil((entries or 0) / ENTRIES), min(16, math.ceil(count / BLOCK)))
    order = [*([F.size("r")] if "r" in by else []), F.col("first")]
    packed = classes.repartitionByRange(tiles, *order).mapInArrow(_packed(kind), "tile long, " + ", ".join(f"{c} binary" for c in _columns(kind)))
    blocks = cut(packed, "blocks")
    one = blocks.repartitionByRange(tiles, "tile")  # a block a partition, so that a task has two
    others = one.select([F.col(c).alias(f"__{c}") for c in blocks.columns]).hint("shuffle_replicate_nl")
    found = one.join(others, F.col("tile") <= F.col("__tile")).mapInArrow(_summarise(kind), "first long, pairs long, total double, most double, partner long, own double")
    best = F.struct("most", -F.col("partner"))
    apart = found.groupBy("first").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.max("most").alias("most"), F.max_by("partner", F.when(F.col("most").isNotNull(), best)).alias("partner"), F.max("own").alias("own"))
    c = classes.select("first", "n", *[F.col(x).alias(f"__{x}") for x in by])
    same = F.lit(True)
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    members = cut(rows.join(c, same).select("strategy_id", "first", "n"), "members")
    second = members.filter("strategy_id <> first").groupBy("first").agg(F.min("strategy_id").alias("second"))
    # of its own class a strategy sees all others, at the value `own`; the smallest of them is the first, or for the first the second
    x = members.join(apart, "first").join(second, "first", "left").withColumn("own", F.when(F.col("n") > 1, F.col("own"))).withColumn("twin", F.when(F.col("own").isNotNull(), F.when(F.col("strategy_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))))
    x = x.withColumn("pairs", F.col("pairs") + F.when(F.col("own").isNotNull(), F.col("n") - 1).otherwise(0)).withColumn("total", F.col("total") + F.coalesce(F.col("own") * (F.col("n") - 1), F.lit(0.0))).filter("pairs > 0")
    own = F.when(F.col("own").isNotNull(), F.struct(F.col("own").alias("most"), -F.col("twin")))
    other = F.when(F.col("most").isNotNull(), F.struct("most", -F.col("partner")))
    nearest_ = F.when(own.isNull() | (other.isNotNull() & (other > own)), F.col("partner")).otherwise(F.col("twin"))
    return x.select("strategy_id", "pairs", (F.col("total") / F.col("pairs")).alias("mean"), F.greatest("most", "own").alias("most"), nearest_.alias("partner"), "total")


def _nearest(kind: str):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "ref_id": [], "value": []}
        if vectors.num_rows and queries.num_rows:
            ids, q_ids = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            order = np.argsort(ids)
            ids, x, q = ids[order], np.array(vectors["embedding"].to_pylist(), np.float64)[order], np.array(queries["embedding"].to_pylist(), np.float64)
            for i in range(0, len(q), 64):
                if kind == "cosine":
                    with np.errstate(all="ignore"):
                        v = -np.round((q[i : i + 64] @ x.T) / (np.linalg.norm(q[i : i + 64], axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]) + 3.05e-11, 9)
                else:
                    v = np.round(np.sqrt(((q[i : i + 64, None, :] - x[None]) ** 2).sum(2)) + 3.05e-11, 9)
                v = np.where((q_ids[i : i + 64, None] == ids[None, :]) | np.isnan(v), np.inf, v)
                best = v.argmin(1)  # of equals the smallest id
                for j, b in enumerate(best.tolist()):
                    if np.isfinite(v[j, b]):
                        out["query_id"].append(int(q_ids[i + j]))
                        out["ref_id"].append(int(ids[b]))
                        out["value"].append(float(-v[j, b] if kind == "cosine" else v[j, b]))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "ref_id": pa.array(out["ref_id"], pa.int64()), "value": pa.array(out["value"], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, kind: str = "cosine") -> DataFrame:
    """`query_id`, `ref_id`, `value`: the most similar (or, kind "distance", the nearest) other vector of all `vectors` for each query.

    Exact, to 9 digits; ties go to the smaller id. A task compares a block of vectors with a block of queries. Rows without
    id or vector, and vectors of another length than the query's, take no part.
    """
    clean = lambda df: df.filter("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long"), "embedding", F.size("embedding").alias("n"))
    v, q = clean(vectors), clean(queries)
    shards, blocks = max(1, math.ceil(v.count() / 8192)), max(1, math.ceil(q.count() / 1024))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", each(blocks))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", each(shards))
    found = v.groupBy("shard", "block", "n").cogroup(q.groupBy("shard", "block", "n")).applyInArrow(_nearest(kind), "query_id long, ref_id long, value double")
    order = F.struct("value", -F.col("ref_id")) if kind == "cosine" else F.struct(-F.col("value"), -F.col("ref_id"))
    return found.groupBy("query_id").agg(F.max_by("ref_id", order).alias("ref_id"), (F.max if kind == "cosine" else F.min)("value").alias("value"))
