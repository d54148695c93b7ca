"""What a caller may pass in: metrics, signals, backtests, objectives, callbacks, and named strategies instead of loaded code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .bars import mean, std
from .simulate import simulate_signals, summarise

#: Whole numbers as pandas has them.
WHOLE = {ByteType: "int8", ShortType: "int16", IntegerType: "int32", LongType: "int64"}


def backtest_each(frames: DataFrame, by: str, fn: Callable[[pd.DataFrame], dict[str, float]], metrics: list[str]) -> DataFrame:
    """A caller's backtest (frame to metrics) of every group; a metric that it leaves out is null. A group is one task's frame.

    Sorted groups come many to a batch, and a frame is a slice of it or, where a group goes on, of several: a group costs the
    caller's function and not a batch of its own.
    """
    kind, columns = frames.schema[by].dataType.simpleString(), frames.columns
    whole = {f.name: WHOLE[type(f.dataType)] for f in frames.schema.fields if type(f.dataType) in WHOLE}

    def judged(key, pieces: list[pd.DataFrame]) -> list:
        pdf = pieces[0] if len(pieces) == 1 else pd.concat(pieces)
        pdf.index = pd.RangeIndex(len(pdf))
        if whole:  # nulls of other groups in the batch made floats of these
            mixed = {c: t for c, t in whole.items() if pdf[c].dtype.kind == "f" and pdf[c].notna().all()}
            pdf = pdf.astype(mixed) if mixed else pdf
        found = fn(pdf)
        return [key, *(found.get(m) for m in metrics)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pieces = None, []
        for batch in batches:
            rows, starts = [], np.flatnonzero(batch["__first"].to_numpy(bool)).tolist()
            frame, keys = batch[columns], batch["__key"].tolist()
            for i, (a, b) in enumerate(zip([0, *starts], [*starts, len(batch)], strict=True)):
                if i and pieces:  # what comes before a group's first row is the rest of another
                    rows.append(judged(key, pieces))
                    pieces = []
                if b > a:
                    key = keys[a]
                    pieces.append(frame.iloc[a:b])
            yield pd.DataFrame(rows, columns=["__key", *metrics])
        if pieces:
            yield pd.DataFrame([judged(key, pieces)], columns=["__key", *metrics])

    first = F.row_number().over(Window.partitionBy(by).orderBy(by)) == 1
    marked = frames.select(*columns, F.col(by).cast("string").alias("__key"), first.alias("__first"))
    found = marked.mapInPandas(run, "__key string, " + ", ".join(f"{m} double" for m in metrics))
    return found.select(F.col("__key").cast(kind).alias(by), *metrics)


def with_signal(bars: DataFrame, signal: Callable[[], Column] | Column) -> DataFrame:
    """Bars with `signal` (1, -1 or 0) by a caller's expression over the series; null counts 0."""
    made = signal if isinstance(signal, Column) else signal()
    return bars.withColumn("signal", F.coalesce(made.cast("int"), F.lit(0)))


def over_windows(frames: DataFrame, by: str, order: str, windows: int, backtest: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """A caller's backtest (rows and their keys to metrics, as DataFrames) of every window of every group: equal parts by place."""
    from pyspark.sql import Window

    cut = frames.withColumn("window", F.ntile(windows).over(Window.partitionBy(by).orderBy(order)))
    return backtest(cut, [by, "window"])


def run_callbacks(decisions: DataFrame, column: str, callbacks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each callback gets the rows with its decision, and its rows are united; decisions without one are passed over."""
    out = None
    for name, fn in callbacks.items():
        made = fn(decisions.filter(F.col(column) == name))
        out = made if out is None else out.unionByName(made)
    return out if out is not None else decisions.limit(0)


def evaluate(vectors: DataFrame, objectives: dict[str, Callable[..., Column]], inputs: list[str]) -> DataFrame:
    """A problem's objectives as columns beside every vector: functions of the input columns."""
    return vectors.withColumns({name: fn(*[F.col(c) for c in inputs]) for name, fn in objectives.items()})


def as_objective(bars: DataFrame, signal_of: Callable[..., Column], metric: Callable[[DataFrame], DataFrame] = summarise) -> Callable[..., DataFrame]:
    """A function of parameters that gives the metrics of a backtest on `bars` with these parameters beside them."""

    def objective(**params) -> DataFrame:
        found = metric(simulate_signals(with_signal(bars, signal_of(**params))))
        return found.withColumns({k: F.lit(v) for k, v in params.items()})

    return objective


@dataclass(frozen=True)
class Spec:
    """A named strategy: expressions of entry and exit; nothing is imported or run from a file."""

    entry: Callable[[], Column]
    leave: Callable[[], Column]


REGISTRY: dict[str, Spec] = {
    "above_mean": Spec(lambda: F.col("close") > mean("close", 20), lambda: F.col("close") < mean("close", 20)),
    "two_means": Spec(lambda: mean("close", 10) > mean("close", 30), lambda: mean("close", 10) < mean("close", 30)),
    "below_band": Spec(lambda: F.col("close") < mean("close", 20) - 2 * std("close", 20), lambda: F.col("close") > mean("close", 20)),
}


def register(name: str, entry: Callable[[], Column], leave: Callable[[], Column]) -> None:
    """Add a strategy; a name that is taken is an error."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered")
    REGISTRY[name] = Spec(entry, leave)


def run_registered(bars: DataFrame, name: str) -> DataFrame:
    """Bars with the signal of a registered strategy; an unknown name is an error."""
    if name not in REGISTRY:
        raise KeyError(name)
    spec = REGISTRY[name]
    return with_signal(bars, F.when(spec.entry(), 1).when(spec.leave(), -1).otherwise(0))
