"""Bar files in, tables out: discovery, normalisation, merging, caching, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StructType, TimestampType

#: What headers of bar files are called, by what they are here.
HEADERS = {
    "ts": ["datetime", "timestamp", "date time", "gmt time", "local time"], "date": ["date", "<date>", "<dtyyyymmdd>", "day"], "time": ["time", "<time>"],
    "open": ["open", "<open>", "o"], "high": ["high", "<high>", "h"], "low": ["low", "<low>", "l"], "close": ["close", "<close>", "c", "adj close", "last"], "volume": ["volume", "<vol>", "<volume>", "vol", "v", "tick_volume"],
}
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd HHmmss", "yyyyMMdd HH:mm:ss", "yyyyMMdd HH:mm", "yyyyMMdd", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "dd.MM.yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy"]
ALIASES = {"SPX500": ["spx", "us500", "sp500"], "XAUUSD": ["gold"], "BTCUSDT": ["btc"], "ETHUSDT": ["eth"]}


def spellings(symbol: str) -> list[str]:
    """How a file's name may spell a symbol, and its aliases."""
    s = symbol.lower()
    half = len(s) // 2
    return list(dict.fromkeys([s, s.replace("/", ""), s.replace("/", "_"), s.replace("/", "-"), f"{s[:half]}_{s[half:]}", f"{s[:half]}-{s[half:]}", s.replace("usdt", "usd"), *ALIASES.get(symbol, [])]))


def resolve_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The first file, by name, whose lower-case name has a spelling of each symbol. `files`: path; `symbols`: symbol, spellings; both short lists."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    hit = files.withColumn("name", name).join(F.broadcast(symbols.select("symbol", F.explode("spellings").alias("s"))), F.expr("contains(name, s)"))
    return hit.groupBy("symbol").agg(F.min("path").alias("path"))


def normalised(raw: DataFrame) -> DataFrame:
    """ts, open, high, low, close, volume from any of the known headers.

    Headers are trimmed and put in lower case; several of one meaning are coalesced. Date and time are combined whenever
    both are there. What does not parse is null; rows without a time or a price are dropped; a missing volume is 0.
    """
    known = {c: [h for h in raw.columns if h.strip().lower() in names] for c, names in HEADERS.items()}
    text = lambda c: F.coalesce(*[F.col(f"`{h}`").cast("string") for h in known[c]]) if known[c] else None
    if text("date") is not None and text("time") is not None:
        when = F.concat_ws(" ", text("date"), text("time"))
    else:
        when = text("ts") if text("ts") is not None else text("date") if text("date") is not None else F.col(f"`{raw.columns[0]}`").cast("string")
    ts = F.coalesce(*[F.try_to_timestamp(when, F.lit(f)) for f in FORMATS], F.try_to_timestamp(when))
    number = lambda c: text(c).try_cast("double") if text(c) is not None else F.lit(None).cast("double")
    out = raw.select(ts.alias("ts"), *[number(c).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(number("volume"), F.lit(0.0)).alias("volume"))
    return out.na.drop(subset=["ts", "open", "high", "low", "close"])


def read_text(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """CSV files below a folder, all columns as text, in the first encoding that has a known header and reads every field whole.

    A byte that an encoding doesn't have shows as U+FFFD: a search that stops at the first one decides.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,CSV}").option("header", True)
    raw = None
    for e in encodings:
        raw = reader.option("encoding", e).csv(path)
        if not any(h.strip().lower() in HEADERS["close"] for h in raw.columns):
            continue
        broken = F.lit(any("\ufffd" in h for h in raw.columns))
        for c in raw.columns:
            broken = broken | F.coalesce(F.col(f"`{c}`").contains("\ufffd"), F.lit(False))
        if raw.filter(broken).isEmpty():
            break
    return raw


def read_bars(spark: SparkSession, path: str, fmt: str = "csv", encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Bars of CSV, Parquet or Excel files below a folder; of CSV in the first encoding that reads them whole."""
    if fmt == "parquet":
        return normalised(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path))
    if fmt == "xlsx":
        from . import xlsx

        return normalised(xlsx.table(xlsx.read_cells(spark, path)).drop("path", "row"))
    if fmt != "csv":
        raise ValueError(f"unknown kind of file {fmt}")
    return normalised(read_text(spark, path, encodings))


def discover(spark: SparkSession, path: str, endings: tuple[str, ...] = ("csv", "parquet", "xlsx")) -> DataFrame:
    """`path`, `ending` (lower case) and `length` of every file of the given kinds below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.withColumn("ending", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).filter(F.col("ending").isin(*endings))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Read-through cache: what is stored at `path`, or what `make` gives, stored there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing is stored yet
        make().write.parquet(path)
        return spark.read.parquet(path)


def clear_cache(spark: SparkSession, path: str) -> bool:
    """Delete what is stored at `path`; whether there was something."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def write_merged(bars: DataFrame, path: str) -> None:
    """Bars as CSV with headers, sorted by symbol and time within files of bounded size."""
    bars.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.option("header", True).option("maxRecordsPerFile", 1_000_000).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; nulls are left out."""
    df.write.option("maxRecordsPerFile", 1_000_000).json(path)


def export_strategies(strategies: DataFrame, path: str) -> None:
    """A JSON line for each strategy, in a folder for each origin, with its id, name and what it descends from."""
    strategies.select("origin", F.to_json(F.struct("strategy_id", "name", "parent_id", "mutation_type")).alias("value")).write.partitionBy("origin").option("maxRecordsPerFile", 100_000).text(path)


def markdown(df: DataFrame, columns: list[str], order: list[str], title: str) -> DataFrame:
    """`n`, `line`: a Markdown table of a short report, numbered in order. The report is an aggregate, and is sorted as one."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + len(head)).cast("long").alias("n"), cells.alias("line"))
    return df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(head)], "n long, line string").unionByName(rows)


def manual_strategies(rows: DataFrame, name: str, code: str) -> DataFrame:
    """Rows to append to the table of strategies: id (16 digits of the SHA-256 of name and code), origin, whether Python accepts the code."""
    from ..functions.text import code_ok

    key = F.substring(F.sha2(F.concat_ws("|", F.col(name), F.col(code)), 256), 1, 16)
    return rows.select(key.alias("code_id"), F.col(name).alias("name"), F.lit("manual").alias("origin"), code_ok(F.col(code)).alias("valid"))


def resumable(spark: SparkSession, path: str, steps: int, first: Callable[[], DataFrame], step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The table after `steps` steps, each stored below `path`; a run that finds some of them goes on from the last.

    A step counts as stored when Spark has marked its folder as a success.
    """
    def stored(i: int) -> DataFrame | None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/step-{i}/_SUCCESS")
        there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return spark.read.parquet(f"{path}/step-{i}") if there else None

    done = next((i for i in range(steps, -1, -1) if stored(i) is not None), None)
    state = stored(done) if done is not None else None
    for i in range(0 if done is None else done + 1, steps + 1):
        (first() if state is None else step(state, i)).write.mode("overwrite").parquet(f"{path}/step-{i}")
        state = stored(i)
    return state


def year_of(path: str | Column) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\d{4})", 1)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by `order`, nulls before all.

    By one plain column a task keeps a row for each key that it sees, and nothing is sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    if len(order) == 1 and rest and all(isinstance(df.schema[c].dataType, (BooleanType, DateType, NumericType, TimestampType)) for c in rest):
        none = F.col(order[0]).isNull()
        first = [F.when(F.max(none), F.max_by(c, none)).otherwise(F.min_by(c, order[0])).alias(c) for c in rest]
        return df.groupBy(*keys).agg(*first).select(*df.columns)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def merge_years(parts: DataFrame) -> DataFrame:
    """Yearly parts (symbol, ts, ..., year) as one series: of rows with one time, that of the earliest year stays."""
    return keep_first(parts, ["symbol", "ts"], ["year"]).drop("year")


def write_bars(bars: DataFrame, path: str) -> None:
    """The cache: partitioned by timeframe and symbol; partitions that are written again are replaced, others stay."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "symbol").parquet(path)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the rows of `new` in place of those with the same keys; columns that only one has are null in the other."""
    both = table.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__v")))).filter("__n = 1").drop("__n", "__v")


def coverage(columns: list[str], expected: tuple[str, ...] = ("open", "high", "low", "close")) -> float:
    """Share of the expected columns that a file's header has."""
    have = {c for c, names in HEADERS.items() for h in columns if h.strip().lower() in names}
    return len(have & set(expected)) / len(expected)


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> '' and not startswith(query, '#')")


def synthetic_bars(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """A repeatable walk for smoke tests: noise from arithmetic on the row number."""
    noise = lambda k: F.pmod(F.col("id") * F.lit(7919 * k + seed) + F.lit(104729), F.lit(1000)) / 1000.0 - 0.5
    w = Window.partitionBy("symbol").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = spark.range(n).withColumn("symbol", F.lit("SYNTH")).withColumn("close", 100 + F.sum(noise(1)).over(w))
    return df.select("symbol", F.timestamp_seconds(1577836800 + F.col("id") * 86400).alias("ts"), (F.col("close") - noise(2) / 2).alias("open"), (F.col("close") + 0.6).alias("high"), (F.col("close") - 0.6).alias("low"), "close", (1000 + F.col("id") % 100).cast("double").alias("volume"))


def synthetic_walks(symbols: DataFrame, n: int = 200) -> DataFrame:
    """A repeatable walk of `n` days for each symbol of a table, to try strategies on before there are bars of it: the noise follows from
    the symbol's name and the day."""
    k = F.conv(F.substring(F.md5("symbol"), 1, 6), 16, 10).cast("long") % 1000
    days = symbols.select("symbol", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
    noise = F.pmod(F.col("i") * (F.lit(7919) + F.col("k")) + F.lit(104729) + F.col("k"), F.lit(1000)) / 1000.0 - 0.5
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = days.withColumn("close", 100 + F.sum(noise).over(w))
    return walk.select("symbol", F.timestamp_seconds(1577836800 + F.col("i") * 86400).alias("ts"), "close", (F.col("close") + 0.6).alias("high"), (F.col("close") - 0.6).alias("low"))


def evolve_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with every column of `schema`, in its order and types; what was missing is null."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
