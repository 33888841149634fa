"""The Parquet lake: <type>/symbol=/year=/month=/day=, where the date is the local operating date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.functions.calendar import LOCAL_ZONE, Period, between_utc, local_time, weekdays_only
from tickloom.operators.quality import reconcile, validate_bars

BAR_SCHEMA = T.StructType([T.StructField("timestamp_utc", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
                           T.StructField("volume", T.LongType()), T.StructField("spread", T.IntegerType()), T.StructField("real_volume", T.LongType())])
TICK_SCHEMA = T.StructType([T.StructField("timestamp_utc", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("bid", "ask", "last", "volume", "volume_real")], T.StructField("flags", T.LongType())])
SCHEMAS = {"m1": BAR_SCHEMA, "m15": BAR_SCHEMA, "h1": BAR_SCHEMA, "ticks": TICK_SCHEMA}
_WIDTHS = {"integer": 4, "short": 2, "byte": 1, "boolean": 1, "string": 16}  # bytes of a value in memory; other types take 8
_PARTITIONS = [T.StructField("symbol", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("year", "month", "day")]]


def empty_bars(spark: SparkSession) -> DataFrame:
    return normalise_bars(spark.createDataFrame([], T.StructType([*BAR_SCHEMA.fields, T.StructField("symbol", T.StringType())])))


def _seconds(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def bars_from_broker(raw: DataFrame) -> DataFrame:
    """Broker bars (time in epoch seconds, tick_volume) in the lake's schema."""
    named = raw.withColumn("timestamp_utc", _seconds(F.col("time"))).withColumnRenamed("tick_volume", "volume")
    return named.select(*[F.col(f.name).cast(f.dataType) for f in BAR_SCHEMA])


def ticks_from_broker(raw: DataFrame) -> DataFrame:
    """Broker ticks: time_msc before time, missing side columns are 0, bid and ask must be sound."""
    at = F.timestamp_millis("time_msc").cast("timestamp_ntz") if "time_msc" in raw.columns else _seconds(F.col("time"))
    side = {c: F.coalesce(F.col(c), F.lit(0)) if c in raw.columns else F.lit(0) for c in ("last", "volume", "volume_real", "flags")}
    out = raw.withColumns({"timestamp_utc": at, **side}).select(*[F.col(f.name).cast(f.dataType) for f in TICK_SCHEMA])
    sound = F.coalesce((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")), F.lit(False))
    if out.where(~sound).limit(1).count():
        raise ValueError("ticks with a null or unsound bid or ask")
    return out


def write_lake(df: DataFrame, root: str, kind: str, symbol: str, zone: str = LOCAL_ZONE) -> None:
    """Replace the day partitions that df has rows of; sorted by time inside each file for tight statistics."""
    day = local_time("timestamp_utc", zone)
    typed = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[kind]])
    dated = typed.withColumns({"symbol": F.lit(symbol), "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})
    keys = ["symbol", "year", "month", "day"]
    (dated.repartition(*keys, F.floor(F.hour("timestamp_utc") / 6)).sortWithinPartitions(*keys, "timestamp_utc").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(f"{root}/{kind}"))


def _stored(spark: SparkSession, root: str, kind: str, symbol: str | None, period: Period | None) -> DataFrame:
    df = spark.read.schema(T.StructType([*SCHEMAS[kind].fields, *_PARTITIONS])).parquet(f"{root}/{kind}")
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if period is not None:
        number = lambda d: d.year * 10000 + d.month * 100 + d.day
        last = period.end - dt.timedelta(days=1)
        years = F.col("year").between(period.start.year, last.year)
        df = df.where(years & (F.col("year") * 10000 + F.col("month") * 100 + F.col("day")).between(number(period.start), number(last)))
        df = between_utc(df, *period.bounds_utc)
    return df


def read_lake(spark: SparkSession, root: str, kind: str, symbol: str | None = None, period: Period | None = None) -> DataFrame:
    """Rows of the half-open period; partitions are pruned by local dates and the UTC range reaches the scan."""
    return _stored(spark, root, kind, symbol, period).drop("year", "month", "day")


def _footers(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row for each column chunk: file, bytes, row_group, rows, name, type, codec, has_statistics, first and last (of times).

    Footers are read inside tasks through pyarrow, so the files need a scheme that it opens; no column data is read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs, parquet

        columns = ["file", "bytes", "row_group", "rows", "name", "type", "codec", "has_statistics", "first", "last"]
        for batch in batches:
            for file in batch.file:
                source, path = fs.FileSystem.from_uri(file)
                footer, size = parquet.read_metadata(path, filesystem=source), source.get_file_info(path).size
                kinds = {f.name: str(f.type) for f in footer.schema.to_arrow_schema()}
                rows = []
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    for c in map(group.column, range(group.num_columns)):
                        times = (c.statistics.min, c.statistics.max) if c.is_stats_set and kinds.get(c.path_in_schema, "").startswith("timestamp") else (None, None)
                        rows.append((file, size, g, group.num_rows, c.path_in_schema, kinds.get(c.path_in_schema), c.compression, c.is_stats_set, *times))
                yield pd.DataFrame(rows, columns=columns).astype({"first": "datetime64[us]", "last": "datetime64[us]"})

    kind = "file string, bytes long, row_group int, rows long, name string, type string, codec string, has_statistics boolean, first timestamp_ntz, last timestamp_ntz"
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(max(len(files), 1), 1000))
    return names.mapInPandas(read, kind)


def _listed(spark: SparkSession, root: str, kind: str, symbol: str | None = None, period: Period | None = None) -> list[str]:
    """The files whose partition values, as their paths give them, belong to the symbol and the dates of the period."""
    every = spark.read.schema(T.StructType([*SCHEMAS[kind].fields, *_PARTITIONS])).parquet(f"{root}/{kind}").inputFiles()

    def wanted(file: str) -> bool:
        values = dict(part.split("=", 1) for part in unquote(file).split("/") if "=" in part)
        return symbol in (None, values["symbol"]) and (period is None or period.start <= dt.date(*[int(values[k]) for k in ("year", "month", "day")]) < period.end)

    return [f for f in every if wanted(f)]


def stored_files(spark: SparkSession, root: str, kind: str, symbol: str | None = None, period: Period | None = None) -> DataFrame:
    """(file, bytes, rows, first_utc, last_utc) of the files that hold rows of the period, from partition names and footers alone.

    A footer tells the range of a file's times; a file whose range meets the period counts.
    """
    chunks = _footers(spark, _listed(spark, root, kind, symbol, period)).where("name = 'timestamp_utc'")
    found = chunks.groupBy("file").agg(F.first("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("first").alias("first_utc"), F.max("last").alias("last_utc")).where("rows > 0")
    if period is None:
        return found
    lo, hi = (F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") for t in period.bounds_utc)
    return found.where((F.col("last_utc") >= lo) & (F.col("first_utc") < hi))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"no partitions or rows for {what}")
    return df


def column_chunks(spark: SparkSession, root: str, kind: str, symbol: str | None = None) -> DataFrame:
    """One row for each column chunk of the files of a kind: file, bytes, row_group, rows, name, type, codec, has_statistics, first, last."""
    return _footers(spark, _listed(spark, root, kind, symbol))


def audit_counters(spark: SparkSession, root: str, kind: str, symbol: str) -> DataFrame:
    """One row: rows, and chunks or row groups against the lake's contract, all from footers."""
    names = [f.name for f in SCHEMAS[kind]]
    types = F.create_map(*[F.lit(x) for f in SCHEMAS[kind] for x in (f.name, str(to_arrow_type(f.dataType)))])
    own = F.col("name").isin(names)
    groups = column_chunks(spark, root, kind, symbol).groupBy("file", "row_group").agg(
        F.first("rows").alias("rows"), F.count_if(own & (F.col("codec") != "ZSTD")).alias("codec"), F.count_if(own & ~F.col("has_statistics")).alias("bare"),
        F.count_if(own & ~F.col("type").eqNullSafe(types[F.col("name")])).alias("typed"), (len(names) - F.count_if(own)).alias("absent"))
    sums = {"rows": "rows", "codec": "another_codec", "bare": "without_statistics", "typed": "another_type", "absent": "absent"}
    return groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in sums.items()])


def audit(spark: SparkSession, root: str, kind: str, symbol: str) -> int:
    """Rows of a symbol as written. No rows, or in any file a lake column that is absent, of another type, not ZSTD or without statistics is an AssertionError."""
    found = audit_counters(spark, root, kind, symbol).first().asDict()
    rows = found.pop("rows")
    wrong = {k.replace("_", " "): v for k, v in found.items() if v}
    if wrong or not rows:
        raise AssertionError(f"audit of {kind}: {rows} rows, chunks {wrong}")
    return rows


def normalise_bars(df: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Canonical bar columns with the local time; needs NTZ times in UTC."""
    if not isinstance(df.schema["timestamp_utc"].dataType, T.TimestampNTZType):
        raise TypeError("timestamp_utc must be timestamp_ntz in UTC")
    rest = [F.col(f.name).cast(f.dataType) for f in BAR_SCHEMA if f.name != "timestamp_utc"]
    return df.select("symbol", "timestamp_utc", local_time("timestamp_utc", zone).alias("timestamp_cot"), *rest)


class Context(dict):
    """Bars by timeframe, and in `removed` how many repeated rows each load dropped."""

    def __init__(self) -> None:
        super().__init__()
        self.removed: dict[str, int] = {}


def load_context(spark: SparkSession, root: str, symbol: str, period: Period, kinds: tuple[str, ...] = ("m1", "m15", "h1")) -> Context:
    """Bars of each timeframe, weekdays alone, one row for each time.

    A timeframe without rows is a FileNotFoundError; repeated times that differ and unsound bars are a ValueError.
    """
    out = Context()
    for kind in kinds:
        stored = require_rows(normalise_bars(read_lake(spark, root, kind, symbol, period)), f"{symbol} {kind}")
        bars, out.removed[kind] = reconcile(stored)
        validate_bars(bars)
        out[kind] = require_rows(weekdays_only(bars), f"{symbol} {kind} on weekdays")
    return out


def summarise(frames: dict[str, DataFrame], files: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows, time range and estimated bytes in memory of each timeframe, with files and their bytes if `stored_files` are given."""
    out = None
    for k, df in frames.items():
        one = df.agg(F.count("*").alias("rows"), F.min("timestamp_utc").alias("first_utc"), F.max("timestamp_utc").alias("last_utc")).withColumns({
            "timeframe": F.lit(k), "memory_bytes": F.col("rows") * sum(_WIDTHS.get(f.dataType.typeName(), 8) for f in df.schema)})
        if files is not None:
            one = one.crossJoin(files[k].agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("file_bytes")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("timeframe", "rows", "first_utc", "last_utc", "memory_bytes", *([] if files is None else ["files", "file_bytes"]))
