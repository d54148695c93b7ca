"""Removal of repeated byte strings by sorting suffixes, deep-shallow, over candidate text only.

A string of `window` bytes that also starts in a document with a smaller id is removed. The work is
cut so that no task holds more than a block of documents or a bucket of candidates:

1. Documents are dealt to blocks by hash of their id. The windows of a text fall into segments:
   runs of windows with the same minimizer (smallest hash of the window's 16-byte strings). Equal
   windows have equal minimizers, wherever they are, so a minimizer that only one document has
   needs no more attention. Each block sends each minimizer it has once to the minimizer's bucket.
2. Buckets answer which minimizers occur in several documents (some 15 % of them).
3. Blocks send the text of segments with such minimizers, each distinct text once with the
   smallest id that has it.
4. A bucket sorts all suffixes of its segments that start a window: multikey quicksort with symbols
   of 8 bytes to a shallow depth of 16, then blind tries for the groups that still agree. Suffixes
   that agree in `window` bytes are neighbours; the smallest id of each such group decides. A
   bucket answers with runs of windows that start in a smaller document.
5. Blocks mark the bytes of those windows.

Copies never gather in one task: a string that a third of all documents share reaches its bucket
once for each block, and each block marks its own documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

WINDOW, GRAM, SHALLOW = 50, 16, 16
BLOCK = 8 << 20
#: Longer runs of windows with one minimizer are cut; a segment's length fits a byte.
RUN = 64
_BIG = np.iinfo(np.int64).max
_LOW40 = np.uint64((1 << 40) - 1)


# -- sorting ---------------------------------------------------------------------------------------


def _word(octets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number that orders like the bytes."""
    view = np.lib.stride_tricks.as_strided(octets, (len(octets) - 7, 8), (1, 1))
    return view[at].view(">u8").ravel().astype(np.uint64)


def _first_byte(x: np.ndarray) -> np.ndarray:
    """Index of the highest non-zero byte, from the left."""
    out = np.full(len(x), 7, np.int64)
    for i in range(6, -1, -1):
        out[(x >> np.uint64(8 * (7 - i))) != 0] = i
    return out


def _runs(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


def deep_shallow(octets: np.ndarray, starts: np.ndarray, length: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` by their first `length` bytes, and which begin a group of equal ones.

    `octets` must reach at least 8 bytes beyond every suffix's `length`. Groups that still agree after
    `shallow` bytes get blind tries, all at once, a level at a time: every suffix is compared with
    its trie's first one only, and what is kept of the comparison is where they part (the depth), to
    which side, and the byte there: the branch. Suffixes on one branch are a trie of their own.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = _word(octets, starts)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    for depth in range(8, shallow, 8):
        group = _runs(new)
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            return order, new
        key, g = _word(octets, starts[order[tied]] + depth), group[tied]
        by = np.lexsort((key, g))
        order[tied] = order[tied][by]
        new[tied[1:]] |= (g[by][1:] != g[by][:-1]) | (key[by][1:] != key[by][:-1])
    depths = [*range(shallow, length - 7, 8)]
    depths += [length - 8] if depths[-1] + 8 < length else []
    group = _runs(new)
    open_ = np.flatnonzero(np.bincount(group)[group] > 1)
    while len(open_):
        g = _runs(new)[open_]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        head = order[open_][first][_runs(first)]
        mine = order[open_]
        side, depth_key, branch = np.ones(len(g), np.int64), np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        left = np.flatnonzero(~first)
        for depth in depths:
            if not len(left):
                break
            a, b = _word(octets, starts[mine[left]] + depth), _word(octets, starts[head[left]] + depth)
            parts = a != b
            if parts.any():
                at, a, b = left[parts], a[parts], b[parts]
                byte = _first_byte(a ^ b)
                less = a < b
                side[at] = np.where(less, 0, 2)
                depth_key[at] = np.where(less, depth + byte, -(depth + byte))
                branch[at] = ((a >> ((7 - byte).astype(np.uint64) * np.uint64(8))) & np.uint64(255)).astype(np.int64)
                left = left[~parts]
        by = np.lexsort((branch, depth_key, side, g))
        order[open_] = mine[by]
        changed = np.zeros(len(g), bool)
        for k in (g, side, depth_key, branch):
            changed[1:] |= k[by][1:] != k[by][:-1]
        new[open_] |= changed
        # those that agree with the head are done; a branch with several suffixes is a trie to build
        group = _runs(new)
        many = np.bincount(group)[group] > 1
        open_ = open_[many[open_] & (side[by] != 1)]
    return order, new


# -- segments of a block ---------------------------------------------------------------------------


def _minimizers(a: np.ndarray, part: int = 1 << 15) -> np.ndarray:
    """The smallest 16-byte hash of every window, in parts that fit a processor's cache."""
    wide = WINDOW - GRAM + 1
    n = len(a) - WINDOW + 1
    out = np.empty(n, np.uint64)
    for lo in range(0, n, part):
        hi = min(n, lo + part)
        piece = a[lo : hi + WINDOW - 1]
        h = np.zeros(hi - lo + wide - 1, np.uint64)
        for off in range(0, GRAM, 8):
            h ^= np.ascontiguousarray(np.lib.stride_tricks.as_strided(piece[off:], (len(h), 8), (1, 1))).view("<u8").ravel()
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        span = 1
        while span * 2 <= wide:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        out[lo:hi] = np.minimum(h[: hi - lo], h[wide - span : wide - span + hi - lo])
    return out


class _Block:
    """The texts of a block, one after the other in the order of (id, text), and their segments."""

    def __init__(self, group: pa.Table, buckets: int):
        ids, text = group.column(0), group.column(1)
        group = pa.table({"i": pc.fill_null(ids, _BIG).cast(pa.int64()), "id": ids, "t": pc.fill_null(text, b"" if pa.types.is_binary(text.type) else "").cast(pa.binary())})
        group = group.take(pc.sort_indices(group.select(["i", "t"]), [("i", "ascending"), ("t", "ascending")]))
        self.ids, self.id_column = group["i"].to_numpy(), group["id"]
        texts = group["t"].to_pylist()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.octets = b"".join(texts)
        self._cut(buckets)

    def _cut(self, buckets: int) -> None:
        n = len(self.octets)
        if n < WINDOW:
            self.at = self.n = self.doc = np.zeros(0, np.int64)
            self.key = self.bucket = np.zeros(0, np.uint64)
            return
        m = _minimizers(np.frombuffer(self.octets, np.uint8))
        valid = np.zeros(len(m), bool)  # where windows may start
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if end - start >= WINDOW:
                valid[start : end - WINDOW + 1] = True
        begins = valid.copy()
        begins[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
        stops = valid.copy()
        stops[:-1] &= (m[1:] != m[:-1]) | ~valid[1:]
        at, n_win = np.flatnonzero(begins), np.flatnonzero(stops) - np.flatnonzero(begins) + 1
        if len(n_win) and n_win.max() > RUN:
            parts = -(-n_win // RUN)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, n_win = np.repeat(at, parts) + k * RUN, np.minimum(RUN, np.repeat(n_win, parts) - k * RUN)
        minimum = m[at]
        self.at, self.n = at, n_win
        self.doc = np.searchsorted(self.ends, at, side="right")
        self.bucket, self.key = (minimum >> np.uint64(40)) % np.uint64(buckets), minimum & _LOW40

    def keep(self, kept: dict[int, np.ndarray]) -> None:
        """Only segments whose minimizer is among those kept, by bucket."""
        whole = [(np.uint64(b) << np.uint64(40)) | k for b, k in kept.items()]
        known = np.sort(np.concatenate(whole)) if whole else np.zeros(0, np.uint64)
        own = (self.bucket << np.uint64(40)) | self.key
        i = np.searchsorted(known, own)
        ok = np.flatnonzero((i < len(known)) & (known[np.minimum(i, max(len(known) - 1, 0))] == own)) if len(known) else np.zeros(0, np.int64)
        for name in ("at", "n", "doc", "bucket", "key"):
            setattr(self, name, getattr(self, name)[ok])

    def contexts(self) -> tuple[dict[int, list[bytes]], dict[int, list[int]], list[tuple[int, int]]]:
        """Distinct segment texts by bucket, the smallest id of each, and each segment's (bucket, place)."""
        texts, ids, places, found = {}, {}, [], {}
        octets = self.octets
        for at, n, doc, bucket in zip(self.at.tolist(), (self.n + WINDOW - 1).tolist(), self.ids[self.doc].tolist(), self.bucket.tolist(), strict=True):
            text = octets[at : at + n]
            place = found.get(text)
            if place is None:
                own = texts.setdefault(bucket, [])
                place = found[text] = (bucket, len(own))
                own.append(text)
                ids.setdefault(bucket, []).append(doc)  # documents come by ascending id
            places.append(place)
        return texts, ids, places


def _pack(*parts: bytes) -> bytes:
    head = np.array([len(parts), *(len(p) for p in parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int.from_bytes(raw[:4], "little")
    sizes, at, out = np.frombuffer(raw, "<u4", count, 4), 4 + 4 * count, []
    for size in sizes.tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _keys40(key: np.ndarray) -> tuple[bytes, bytes]:
    return (key >> np.uint64(32)).astype(np.uint8).tobytes(), key.astype("<u4").tobytes()


def _from40(high: bytes, low: bytes) -> np.ndarray:
    return (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)) | np.frombuffer(low, "<u4").astype(np.uint64)


_SENT = "block long, bucket long, kind int, blob binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "bucket", "kind", "blob"])


def _send_minimizers(buckets: int):
    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        b = _Block(group, buckets)
        order = np.lexsort((b.doc, b.key, b.bucket))
        bucket, k, ids = b.bucket[order], b.key[order], b.ids[b.doc[order]] if len(order) else np.zeros(0, np.int64)
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(k)) - 1 if len(at) else at
        several = ids[at] != ids[last]
        ub, cut = np.unique(bucket[at], return_index=True)
        rows = []
        for i, (lo, hi) in enumerate(zip(cut, [*cut[1:], len(at)], strict=True)):
            rows.append((key[0].as_py(), int(ub[i]), 0, _pack(*_keys40(k[at[lo:hi]]), np.packbits(several[lo:hi]).tobytes())))
        return _rows(rows)

    return send


def _resolve_minimizers(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    blocks = group["block"].to_pylist()
    keys, several, owner = [], [], []
    for i, blob in enumerate(group["blob"].to_pylist()):
        high, low, bits = _unpack(blob)
        keys.append(k := _from40(high, low))
        several.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)).astype(bool))
        owner.append(np.full(len(k), i))
    keys, several, owner = np.concatenate(keys), np.concatenate(several), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    run = _runs(new)
    ok = (np.bincount(run) > 1) | (np.bincount(run, weights=several[order]) > 0)
    kept = np.zeros(len(k), bool)
    kept[order] = ok[run]
    rows = []
    for i, block in enumerate(blocks):
        if (mine := kept & (owner == i)).any():
            rows.append((block, key[0].as_py(), 0, _pack(*_keys40(keys[mine]))))
    return _rows(rows)


def _kept_of(sent: pa.Table) -> dict[int, np.ndarray]:
    return {b: _from40(*_unpack(blob)) for b, kind, blob in zip(sent["bucket"].to_pylist(), sent["kind"].to_pylist(), sent["blob"].to_pylist(), strict=True) if kind == 0}


def _send_segments(buckets: int):
    def send(key: tuple[pa.Scalar, ...], group: pa.Table, sent: pa.Table) -> pa.Table:
        if not sent.num_rows or not group.num_rows:
            return _rows([])
        b = _Block(group, buckets)
        b.keep(_kept_of(sent))
        texts, ids, _ = b.contexts()
        return _rows([(key[0].as_py(), bucket, 1, _pack(np.array([len(x) for x in t], np.uint8).tobytes(), np.array(ids[bucket], "<i8").tobytes(), b"".join(t))) for bucket, t in texts.items()])

    return send


def _sort_bucket(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    blocks = group["block"].to_pylist()
    known: dict[bytes, int] = {}
    uses, least = [], []
    for blob in group["blob"].to_pylist():
        lengths, ids, joined = _unpack(blob)
        at, own = 0, []
        ids = np.frombuffer(ids, "<i8")
        for n, doc in zip(lengths, ids.tolist(), strict=True):
            text = joined[at : at + n]
            at += n
            place = known.setdefault(text, len(known))
            if place == len(least):
                least.append(doc)
            elif doc < least[place]:
                least[place] = doc
            own.append(place)
        uses.append((np.array(own, np.int64), ids))
    texts, least = list(known), np.array(least, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    octets = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n_win = lengths - WINDOW + 1
    first = np.cumsum(n_win) - n_win
    which = np.repeat(np.arange(len(texts)), n_win)
    starts = np.repeat(np.cumsum(lengths) - lengths, n_win) + np.arange(n_win.sum()) - np.repeat(first, n_win)
    order, new = deep_shallow(octets, starts)
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.minimum.reduceat(least[which[order]], np.flatnonzero(new))[_runs(new)]
    rows = []
    for block, (own, ids) in zip(blocks, uses, strict=True):
        w = n_win[own]
        base = np.cumsum(w) - w
        local = np.repeat(np.arange(len(own)), w)
        step = np.arange(w.sum()) - base[local]
        hit = smallest[first[own][local] + step] < ids[local]
        opens, closes = hit.copy(), hit.copy()
        opens[1:] &= ~hit[:-1] | (local[1:] != local[:-1])
        closes[:-1] &= ~hit[1:] | (local[1:] != local[:-1])
        if hit.any():
            a, z = np.flatnonzero(opens), np.flatnonzero(closes)
            rows.append((block, key[0].as_py(), 1, _pack(local[a].astype("<u4").tobytes(), step[a].astype(np.uint8).tobytes(), step[z].astype(np.uint8).tobytes())))
    return _rows(rows)


def _mark(buckets: int, id_name: str):
    def mark(key: tuple[pa.Scalar, ...], group: pa.Table, sent: pa.Table) -> pa.Table:
        b = _Block(group, buckets)
        n = len(b.octets)
        edge = np.zeros(n + 1, np.int32)
        if sent.num_rows:
            b.keep(_kept_of(sent))
            _, ids, places = b.contexts()
            runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for bucket, kind, blob in zip(sent["bucket"].to_pylist(), sent["kind"].to_pylist(), sent["blob"].to_pylist(), strict=True):
                if kind == 1:
                    c, a, z = _unpack(blob)
                    for p, x, y in zip(np.frombuffer(c, "<u4").tolist(), a, z, strict=True):
                        runs.setdefault((bucket, p), []).append((x, y))
            lo, hi = [], []
            for place, at, n_win, doc in zip(places, b.at.tolist(), b.n.tolist(), b.ids[b.doc].tolist(), strict=True):
                if ids[place[0]][place[1]] < doc:  # a smaller document of this block has the whole segment
                    lo.append(at)
                    hi.append(at + n_win - 1 + WINDOW)
                else:
                    for x, y in runs.get(place, ()):
                        lo.append(at + x)
                        hi.append(at + y + WINDOW)
            np.add.at(edge, np.array(lo, np.int64), 1)
            np.add.at(edge, np.array(hi, np.int64), -1)
        covered = np.cumsum(edge, dtype=np.int32)[:n] > 0
        a = np.frombuffer(b.octets, np.uint8)
        kept, spans = [], []
        n_cov = np.zeros(n + 1, np.int64)
        np.cumsum(covered, out=n_cov[1:])
        for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
            if n_cov[e] == n_cov[s]:
                kept.append(b.octets[s:e])
                spans.append([])
                continue
            mine = covered[s:e]
            kept.append(a[s:e][~mine].tobytes())
            step = np.diff(mine.astype(np.int8), prepend=0, append=0)
            spans.append([{"start": x, "end": y} for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)])
        return pa.table({id_name: b.id_column, "n_bytes": pa.array(b.lengths, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return mark


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """Texts without the bytes of 50-byte strings that also start in a document with a smaller id.

    Returns id, `n_bytes`, `kept` (the remaining bytes) and `spans` (maximal removed runs, as byte
    offsets). Overlaps count, strings are judged on the input and never cross documents. A null text
    is empty; a text below 50 bytes stays; a null id counts as the largest; rows that repeat an id do
    not remove each other; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(n)))
    by_block = lambda: dealt.groupBy("block")
    # "block" comes last, so that a group's first two columns are the id and the text
    kept = saved(by_block().applyInArrow(_send_minimizers(n), _SENT).groupBy("bucket").applyInArrow(_resolve_minimizers, _SENT), "minimizers")
    segments = by_block().cogroup(kept.groupBy("block")).applyInArrow(_send_segments(n), _SENT)
    runs = saved(segments.groupBy("bucket").applyInArrow(_sort_bucket, _SENT), "windows")
    out = f"{id_col} long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"
    return by_block().cogroup(kept.unionByName(runs).groupBy("block")).applyInArrow(_mark(n, id_col), out)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of all documents: what is removed and a digest of what stays."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
