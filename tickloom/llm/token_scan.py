"""Token counts by a separator scan over flat token files that have no index.

A token file is a sequence of fixed-width little-endian identifiers; every document ends with the
end-of-document identifier. Files are cut into blocks at multiples of the width, wherever documents
begin or end. A task reads a block as one array and finds all separators with one vectorised
comparison. What crosses a block's edge is stitched by a prefix scan over the blocks of its file:
a running count of separators gives document numbers, a running maximum of separator positions
gives where the open document began.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import create, open_random
from .shared import saved, scratch, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK = 8 << 20
FILE = 128 << 20


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, tokenizer: str, pattern: str, eod: int, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = _encoder(tokenizer, pattern).encode_ordinary, np.dtype(f"<u{width}")
        out, name, ordinal, size = None, "", 0, 0
        try:
            for batch in batches:
                names, places, ids = [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if out is None or size >= FILE:
                        if out is not None:
                            out.close()
                        # an attempt that fails leaves a file that no returned row names
                        name, ordinal, size = f"{folder}/{uuid.uuid4().hex}.tok", 0, 0
                        out = create(name)
                    tokens = np.array([*encode(text or ""), eod], dtype=kind)
                    out.write(tokens.tobytes())
                    size += tokens.nbytes
                    names.append(name)
                    places.append(ordinal)
                    ids.append(doc_id)
                    ordinal += 1
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(ids, batch.schema.field(0).type)], names=["file", "ordinal", batch.schema.names[0]])
        finally:
            if out is not None:
                out.close()

    return write


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN, eod: int = EOD, width: int = 2) -> DataFrame:
    """Tokenise texts into flat files in the shared folder; returns which document lies where (file, ordinal, id).

    A null text is a document without tokens, and so is an empty one; rows that repeat an id are documents of their own; a text
    of any length is tokenised whole; an empty table gives no files. Every executor reads the vocabulary at `tokenizer`. `width` is the bytes of an identifier (2 or 4). The
    returned table is stored, so the files are written once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(_writer(scratch(spark, "tokens"), tokenizer, pattern, eod, width), f"file string, ordinal long, {id_col} {kind}")
    return saved(rows, "token-manifest")


def _scan_blocks(eod: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with open_random(file) as f:
                    f.seek(offset)
                    a = np.frombuffer(f.read(length), dtype=f"<u{width}")
                at = np.flatnonzero(a == eod)
                inner = np.diff(at) - 1
                yield pa.record_batch(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([offset // width], pa.int64()), pa.array([len(a)], pa.int64()), pa.array([at[0] if len(at) else None], pa.int64()), pa.array([at[-1] if len(at) else None], pa.int64()), pa.array([inner], pa.list_(pa.int64()))],
                    names=["file", "block", "start", "n", "first", "last", "inner"],
                )

    return scan


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = []
        for name in batch.column(0).to_pylist():
            with open_random(name) as f:
                sizes.append(f.size())
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"])


def count_tokens(files: DataFrame, eod: int = EOD, width: int = 2, block_bytes: int = BLOCK) -> DataFrame:
    """Tokens of every document of flat token files: `file`, `ordinal` (from 0), `n_tokens`, `closed`.

    `files` has a column `file` (URIs); nulls and repeated names are dropped. Documents do not cross
    files. Tokens after a file's last separator are a document with `closed` false; an empty file has
    none. A document without tokens counts 0. A file's length must be a multiple of `width`: a partial
    identifier at its end is ignored.
    """
    block_bytes -= block_bytes % width
    sizes = files.filter("file is not null").select("file").distinct().mapInArrow(_sizes, "file string, bytes long")
    usable = F.col("bytes") - F.col("bytes") % width
    blocks = sizes.filter(usable > 0).select("file", usable.alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((usable - 1) / block_bytes))).alias("block"))
    offset = F.col("block") * block_bytes
    blocks = blocks.select("file", "block", offset.alias("offset"), F.least(F.lit(block_bytes), F.col("bytes") - offset).alias("length"))
    found = blocks.repartition("file", "block").mapInArrow(_scan_blocks(eod, width), "file string, block long, start long, n long, first long, last long, inner array<long>")
    found = saved(found, "token-blocks")
    # The prefix scan: what lies before a block in its file, from a few numbers a block; the separators stay where they are.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n_seps = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.col("n_inner") + 1)
    scanned = (
        found.select("file", "block", "start", "n", "first", "last", F.size("inner").alias("n_inner")).withColumn("done", F.coalesce(F.sum(n_seps).over(before), F.lit(0)))
        .withColumn("open_from", F.coalesce(F.max(F.col("start") + F.col("last") + 1).over(before), F.lit(0).cast("long")))
        .withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    )
    head = F.col("start") + F.col("first") - F.col("open_from")
    ended = scanned.filter("first is not null").join(found.select("file", "block", "inner"), ["file", "block"]).select("file", "done", F.posexplode(F.concat(F.array(head), "inner")).alias("i", "n_tokens")).select("file", (F.col("done") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    rest = F.col("start") + F.col("n") - F.coalesce(F.col("start") + F.col("last") + 1, F.col("open_from"))
    tail = scanned.filter("is_last").select("file", (F.col("done") + n_seps).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return ended.unionByName(tail)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files that hold all of them."""
    manifest = write_token_files(table(spark, sf_dir, "documents"))
    counts = count_tokens(manifest.select("file"))
    return manifest.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


QUERIES = {"op9_token_counts": op9_token_counts}
