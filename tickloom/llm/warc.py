"""WARC archives with a two-level capture index.

Writing: each task appends gzip members (one WARC record each) to archives of bounded size in the
shared folder. A page whose payload repeats that of a page with a smaller id becomes a revisit record.

Index: one line for each capture, keyed by its reversed-host URL key (`com,example,www)/path?query`), the page id,
and where its record lies. Lines are sorted by key over the cluster and cut into blocks of a fixed
number of lines; each block is compressed alone. The sparse directory above has only the first key of
each block, its file, offset and length: fixed places in a file of its own, found by binary
search with range reads. No table of the index is ever held whole, in the driver or in a task.

Lookup: binary search in the directory, a range read of a block, binary search in it, a range read of
the record. Queries are sorted by key first, so that neighbours use the same block.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import unicodedata
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import create, open_random
from .shared import saved, scratch, table

BLOCK_LINES, ARCHIVE = 512, 256 << 20
#: Blocks that a task writes, and records that a task looks up.
BLOCKS_A_TASK, LOOKUPS_A_TASK = 64, 8192
#: Payloads of at least this many rows, and a thousandth of all, meet them by broadcast.
HOT_ROWS = 10_000
#: Payloads below this many bytes are always responses.
SMALLEST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, file string, offset long, length long"


def escaped(url: str | None) -> str:
    """The URL with white space, line ends and control characters of any alphabet as percent codes: it fits a header line and an index line."""
    return "".join(quote(c) if c.isspace() or not (c.isprintable() or unicodedata.category(c) in ("Co", "Cn")) else c for c in url or "")


def url_key(url: str | None) -> str:
    """Reversed-host key of a URL, escaped: host labels from the right, no scheme, `www.`, port or fragment; path and query as they are."""
    url = escaped(url)
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def _record_id(page_id: int, digest: str) -> str:
    return f"<urn:page:{page_id}:{digest}>"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A WARC record, not compressed: a response with its payload, or a revisit that names a response."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Target-URI: {escaped(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {escaped(refers_url)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _page_of(record_id: str) -> int:
    return int(record_id.split(":")[2])


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        try:
            for batch in batches:
                cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                rows = []
                for page_id, url, html, digest, refers, refers_url in zip(cols["page_id"], cols["url"], cols["html"], cols["digest"], cols["refers_to"], cols["refers_url"], strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        # a failed attempt leaves an archive that no capture names
                        name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = create(name)
                    member = _gzip(record(page_id, url, (html or "").encode(), digest, refers, refers_url))
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                yield _table(rows, CAPTURES)
        finally:
            if out is not None:
                out.close()

    return write


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, _ARROW[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _payloads(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`digest`, `refers_to`, `refers_url` of payloads that several page ids have: those of very many rows, and the others.

    Only payloads of at least a thousandth of the rows are in the first table, so it has 1000 rows at most.
    """
    big = keys.filter("big")
    found = big.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    found = saved(found.filter("refers_to < last").drop("last"), "warc-payloads")
    many = max(HOT_ROWS, keys.count() / 1000)

    def with_url(part: DataFrame, hint: str) -> DataFrame:
        # of rows that repeat the first page id the smallest URL: combined in the map tasks
        wanted = part.select("digest", F.col("refers_to").alias("page_id"))
        urls = big.select("digest", "page_id", "url").join(wanted.hint(hint), ["digest", "page_id"]).groupBy("digest").agg(F.min("url").alias("refers_url"))
        return part.drop("n").join(urls.hint(hint), "digest", "left")

    return saved(with_url(found.filter(F.col("n") >= many), "broadcast"), "warc-hot"), saved(with_url(found.filter(F.col("n") < many), "merge"), "warc-repeated")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record for every row of (`page_id`, `url`, `html`); returns the captures (key, page_id, file, offset, length), stored.

    Of rows with equal payloads of 100 bytes or more that with the smallest page_id is the response. Null html is
    an empty payload; a null url has the key of an empty one; white space and control characters of a url are percent
    codes in headers and keys. Rows that repeat a page_id are records of their own, each with its own payload;
    if one of them is the first of its payload, so are its copies with that id. A null page_id is left out; an
    empty table gives no rows; other columns are ignored. A payload that very many rows share meets them by
    broadcast, so that no task gathers its rows; all others meet theirs in a join by digest.
    """
    rows = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256)).withColumn("big", F.coalesce(F.octet_length("html"), F.lit(0)) >= SMALLEST_REVISIT)
    hot, repeated = _payloads(saved(rows.select("page_id", "url", "digest", "big"), "warc-keys"))
    hot_rows = rows.filter("big").join(F.broadcast(hot), "digest")
    others = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("big"))), ["digest", "big"], "left_anti")
    others = others.join(repeated.withColumn("big", F.lit(True)).hint("merge"), ["digest", "big"], "left")
    full = hot_rows.unionByName(others).drop("big").withColumn("refers_to", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")))
    return saved(full.mapInArrow(_writer(scratch(pages.sparkSession, "warc")), CAPTURES), "warc-captures")


# -- index -----------------------------------------------------------------------------------------

DIRECTORY = "first string, page_id long, file string, offset long, length long"


def _block_writer(folder: str, lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, pending, done = None, f"{folder}/{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def flush():
            nonlocal out, at, pending
            out = out or create(name)
            block = _gzip("".join("\t".join(map(str, r)) + "\n" for r in pending).encode())
            out.write(block)
            done.append((pending[0][0], pending[0][1], name, at, len(block)))
            at, pending = at + len(block), []

        try:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    pending.append(row)
                    if len(pending) == lines:
                        flush()
                if done:
                    yield _table(done, DIRECTORY)
                    done.clear()
            if pending:
                flush()
                yield _table(done, DIRECTORY)
        finally:
            if out is not None:
                out.close()

    return write


def _directory_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One sorted part of the directory: entries, then their offsets as 8 bytes each."""
        name, out, at, places, head = f"{folder}/{uuid.uuid4().hex}.dir", None, 0, [], None
        try:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    out, head = out or create(name), head or row
                    entry = "\t".join(map(str, row)).encode() + b"\n"
                    out.write(entry)
                    places.append(at)
                    at += len(entry)
            if head:
                out.write(b"".join(p.to_bytes(8, "little") for p in [*places, at]))
                yield _table([(head[0], head[1], name, at, len(places))], DIRECTORY)
        finally:
            if out is not None:
                out.close()

    return write


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into compressed blocks below a sparse directory; returns the directory's parts (first key, file, size).

    Captures are dealt by ranges of (key, page_id), so that a host with most of the pages spreads over many
    tasks. The directory is dealt likewise; its parts are a row each, as many as there are partitions.
    """
    spark = captures.sparkSession
    tasks = max(1, math.ceil(captures.count() / (BLOCKS_A_TASK * block_lines)))
    in_order = captures.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    blocks = saved(in_order.mapInArrow(_block_writer(scratch(spark, "cdx"), block_lines), DIRECTORY), "cdx-blocks")
    parts = max(1, blocks.count() // 100_000)
    sparse = blocks.repartitionByRange(parts, "first", "page_id").sortWithinPartitions("first", "page_id")
    return saved(sparse.mapInArrow(_directory_writer(scratch(spark, "cdx-directory")), DIRECTORY), "cdx-directory")


class Reader:
    """Lookups by (key, page id) for one task; keeps the last blocks and records it has read."""

    def __init__(self, parts: list[tuple[str, int, str, int, int]], keep: int = 8):
        self.parts = sorted(parts)
        self.firsts = [(p[0], p[1]) for p in self.parts]
        self.files: OrderedDict = OrderedDict()
        self.entries: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.records: OrderedDict = OrderedDict()
        self.keep = keep

    def _cached(self, cache: OrderedDict, key, make, most: int | None = None):
        if key not in cache:
            cache[key] = make()
            while len(cache) > (most or self.keep):
                old = cache.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
        cache.move_to_end(key)
        return cache[key]

    def _range(self, uri: str, at: int, n: int) -> bytes:
        f = self._cached(self.files, uri, lambda: open_random(uri))
        f.seek(at)
        return f.read(n)

    def _entry(self, part: tuple, i: int) -> list[str]:
        name, base = part[2], part[3]
        a, b = (int.from_bytes(x, "little") for x in (lambda r: (r[:8], r[8:]))(self._range(name, base + 8 * i, 16)))
        return self._range(name, a, b - a).decode().rstrip("\n").split("\t")

    def _first_block(self, wanted: tuple[str, int]) -> tuple[int, int]:
        """Part and place of the last block that begins before `wanted`: its captures begin there or in the next one."""
        p = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        lo, hi = 0, self.parts[p][4] - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._begins(p, mid) < wanted else (lo, mid - 1)
        return p, lo

    def _read_entry(self, p: int, i: int) -> list[str]:
        part = self.parts[p]
        return self._cached(self.entries, (part[2], i), lambda: self._entry(part, i), 4096)

    def _begins(self, p: int, i: int) -> tuple[str, int]:
        entry = self._read_entry(p, i)
        return entry[0], int(entry[1])

    def find(self, key: str, page_id: int) -> list[tuple]:
        """All captures (key, page_id, file, offset, length) of a key and page id; several if rows repeat them."""
        if not self.parts:
            return []
        wanted, out = (key, page_id), []
        p, i = self._first_block(wanted)
        while p < len(self.parts) and self._begins(p, i) <= wanted:
            _, _, name, at, n = self._read_entry(p, i)
            lines = self._cached(self.blocks, (name, at), lambda: _lines(zlib.decompress(self._range(name, int(at), int(n)), 31)))  # noqa: B023
            out += lines[bisect.bisect_left(lines, wanted) : bisect.bisect_right(lines, wanted, key=lambda x: x[:2])]
            p, i = (p, i + 1) if i + 1 < self.parts[p][4] else (p + 1, 0)
        return out

    def read(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse_record(zlib.decompress(self._range(file, offset, length), 31))

    def _response(self, record_id: str, url: str) -> bytes:
        for at in self.find(url_key(url), _page_of(record_id)):
            headers, payload = self.read(*at[2:])
            if headers["WARC-Record-ID"] == record_id and headers["WARC-Type"] == "response":
                return payload
        raise ValueError(f"no response {record_id}")

    def fetch(self, key: str, page_id: int) -> list[tuple[dict[str, str], bytes]]:
        """Headers and full payload of all captures; a revisit gets the payload of the response that it names."""
        out = []
        for at in self.find(key, page_id):
            headers, payload = self.read(*at[2:])
            if headers["WARC-Type"] == "revisit":
                named = headers["WARC-Refers-To"], headers["WARC-Refers-To-Target-URI"]
                payload = self._cached(self.records, named[0], lambda: self._response(*named))  # noqa: B023
            out.append((headers, payload))
        return out


def _lines(raw: bytes) -> list[tuple]:
    return [(k, int(p), f, int(o), int(n)) for k, p, f, o, n in (x.split("\t") for x in raw.decode().split("\n") if x)]


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def _lookup(parts: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, before = Reader(parts), None
        for batch in batches:
            rows = []
            for wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if wanted == before:  # sorted: repeated queries are neighbours
                    continue
                before = wanted
                for headers, payload in reader.fetch(*wanted):
                    refers = _page_of(headers["WARC-Refers-To"]) if headers["WARC-Type"] == "revisit" else None
                    rows.append((wanted[1], len(payload), hashlib.sha256(payload).hexdigest(), headers["WARC-Type"], refers, headers["WARC-Target-URI"]))
            yield _table(rows, FOUND)

    return run


def lookup(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The captures of each distinct row of `queries` (`key`, `page_id`): sizes and digest of the full payload, read from the archives.

    Rows that are not in the index give no row; a key and page id that several captures have give them all. Nulls
    find nothing. The directory's parts (their first keys and files, one for each 100,000 blocks) go to the tasks;
    entries, blocks and records are range reads. The number of tasks follows the number of queries.
    """
    parts = [tuple(r) for r in index.collect()]
    asked = queries.select("key", "page_id").na.drop()
    tasks = max(1, math.ceil(asked.count() / LOOKUPS_A_TASK))
    in_order = asked.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return in_order.mapInArrow(_lookup(parts), FOUND)


def op7_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives, indexed, and read back through the index."""
    captures = write_archives(table(spark, sf_dir, "pages"))
    return lookup(build_index(captures), captures).drop("target_uri")


OP7_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to FROM f
"""

QUERIES = {"op7_warc_captures": op7_warc_captures}
ORACLE = {"op7_warc_captures": OP7_SQL}
