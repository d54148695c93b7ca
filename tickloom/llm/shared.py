"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder; any path that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tickloom-')}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder of the cluster (`spark.checkpoint.dir`).

    Only a session on one machine may do without that setting, and gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(base or _own_folder()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Spark 4.1 and later: shuffle files go at the end of the execution that made them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: this cuts its lineage.

    The files outlive any executor. `df` is not executed again, so the shuffle files of the write go
    as soon as it ends, rather than when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with setting(spark, CLEAN_UP, "true"):
        df.write.options(**options).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `saved` wrote: all that reads them must be stored itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key of at least this many rows, and a thousandth of all, is joined by broadcast.
HOT_ROWS = 10_000


def spread_join(rows: DataFrame, keys: DataFrame, on: str | list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of `rows` with one row of `keys` for each value of `on`, where a value may have a third of all rows.

    `keys` says in column `n` (dropped) how many rows a value has, and `total` bounds their sum. Values of at least a
    thousandth of `total`, 1000 at most, meet their rows by broadcast, so that no task gathers them; all others by shuffle.
    The columns of `keys` must be of bounded size, which bounds the broadcast in bytes.
    """
    return spread_split(rows, keys, on, total, n)[0]


def spread_split(rows: DataFrame, keys: DataFrame, on: str | list[str], total: int, n: str = "n") -> tuple[DataFrame, DataFrame]:
    """The rows joined as by `spread_join`, and the rows whose value `keys` lacks."""
    many, names = max(HOT_ROWS, total / 1000), [on] if isinstance(on, str) else on
    hot, cold = keys.filter(F.col(n) >= many).drop(n), keys.filter(F.col(n) < many).drop(n)
    rest = rows.join(F.broadcast(hot.select(*names)), names, "left_anti")
    matched = rows.join(F.broadcast(hot), names).unionByName(rest.join(cold.hint("shuffle_hash"), names))
    return matched, rest.join(cold.select(*names).hint("shuffle_hash"), names, "left_anti")


def unit_hash(*cols) -> F.Column:
    """A hash in [0, 2**40) that DuckDB computes alike: the first ten hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 10), 16, 10).cast("long")
