"""Stored intermediates, below the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tickloom-shared-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only a session on one machine may do without, with a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (base or _own_folder()).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows that a task sorts in memory, whatever the table.
ROWS_A_TASK = 1_000_000


@contextmanager
def shuffles_for(spark: SparkSession, rows: int):
    """Shuffles of what is executed inside have a partition for each million rows at least, so that their sorts need not spill."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-rows // ROWS_A_TASK))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` below the shared folder and read it back: this cuts its lineage, and no executor need survive."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
