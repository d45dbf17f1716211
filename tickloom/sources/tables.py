"""Scans, anchors, shard layout and sinks. Bounds become predicates, so Spark prunes partitions and row groups."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEPTH, book_columns, require
from .shards import choose

#: Columns of the scans.
TRADE_COLUMNS = ("inst_id", "trade_id", "ts_event", "ts_ingest", "price", "size", "side")
MARK_PRICE_COLUMNS = ("inst_id", "ts_event", "ts_ingest", "mark_px")


def check_identifier(name: str, kind: str = "identifier") -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"bad {kind}: {name!r}")
    return name


def jdbc_table(spark: SparkSession, url: str, schema: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table by JDBC; partition: (column, lower, upper, parts) to read it in parallel. Predicates and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{check_identifier(schema)}.{check_identifier(table)}").options(**options)
    if partition:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(k, str(v))
    return reader.load()


def postgres_url(host: str | None = None, port: int | str | None = None, database: str | None = None, user: str | None = None, password: str | None = None) -> tuple[str, dict[str, str]]:
    """(JDBC URL, options with user and password); what is not given comes from PGHOST, PGPORT, PGDATABASE, PGUSER and PGPASSWORD."""
    take = lambda x, name, default=None: x if x is not None else os.environ.get(name, default)
    url = f"jdbc:postgresql://{take(host, 'PGHOST', 'localhost')}:{take(port, 'PGPORT', 5432)}/{take(database, 'PGDATABASE', 'postgres')}"
    return url, {k: v for k, v in (("user", take(user, "PGUSER")), ("password", take(password, "PGPASSWORD"))) if v is not None}


def snapshot_scan(df: DataFrame, inst_id: str, start=None, end=None, depth: int = DEPTH) -> DataFrame:
    """Wide snapshots of an instrument, both bounds in, in time order; raises if a column of the contract is missing."""
    require(df, ["inst_id", "ts_event", *book_columns(depth)])
    return scan(df, inst_id, start, end, columns=["inst_id", "ts_event", *book_columns(depth)]).orderBy("ts_event")


def renamed_time(df: DataFrame, time_col: str) -> DataFrame:
    return df if time_col == "ts_event" else df.withColumnRenamed(time_col, "ts_event")


def core_updates(df: DataFrame, inst_id: str, start=None, end=None, time_col: str = "ts_event", price_col: str = "price", size_col: str = "size") -> DataFrame:
    """(ts_event, side, price, size) of an instrument's updates, both bounds in."""
    return scan(df, inst_id, start, end, time_col).select(F.col(time_col).alias("ts_event"), "side", F.col(price_col).alias("price"), F.col(size_col).alias("size"))


def update_stats(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """(inst_id, n, first_us, last_us) of the updates in [start, end]: what a scan would read."""
    return presence(df.where(F.col("ts_us").between(start_us, end_us)))


def anchor_rows(snapshots: DataFrame, at: Column, strict: bool = True, by: Sequence[str] = ("inst_id",), time_col: str = "ts_us") -> DataFrame:
    """All rows (levels) of the last snapshot before `at` (strict) or at it too: a grouped maximum and a join with it."""
    near = snapshots.where(F.col(time_col) < at if strict else F.col(time_col) <= at)
    last = near.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.max(time_col).alias("__last"))
    on = [F.col(c) == F.col(f"__{c}") for c in by] + [F.col(time_col) == F.col("__last")]
    return near.join(last, on).select(*snapshots.columns)


def snapshot_at(snapshots: DataFrame, inst_id: str, at_us: int, time_col: str = "ts_us") -> DataFrame:
    """The rows of an instrument's snapshot at exactly this time; FileNotFoundError if there is none."""
    found = snapshots.where((F.col("inst_id") == inst_id) & (F.col(time_col) == at_us))
    if found.isEmpty():
        raise FileNotFoundError(f"no snapshot of {inst_id} at {at_us}")
    return found


def scan(df: DataFrame, inst_id: str | None = None, start=None, end=None, time_col: str = "ts_event", columns: Sequence[str] | None = None, closed: bool = True) -> DataFrame:
    """Rows of an instrument with time in [start, end] ([start, end) if not closed); a bound that is None is no predicate."""
    if inst_id is not None:
        df = df.where(F.col("inst_id") == inst_id)
    if start is not None:
        df = df.where(F.col(time_col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time_col) <= F.lit(end) if closed else F.col(time_col) < F.lit(end))
    return df.select(*columns) if columns else df


def anchor(snapshots: DataFrame, at: Column, strict: bool = True, by: Sequence[str] = ("inst_id",), time_col: str = "ts_us") -> DataFrame:
    """The last snapshot before `at` (strict) or at it too, one row for each of `by`, with its columns."""
    near = snapshots.where(F.col(time_col) < at if strict else F.col(time_col) <= at)
    return near.groupBy(*by).agg(F.max_by(F.struct(*(F.col(c) for c in snapshots.columns)), time_col).alias("s")).select("s.*")


def one_snapshot_id(rows: DataFrame, by: Sequence[str] = ("inst_id", "ts_us")) -> DataFrame:
    """Of several snapshot ids at one time, the rows of the one with most levels (the smallest of equals)."""
    counts = rows.groupBy(*by, "snapshot_id").agg(F.count("*").alias("__n"))
    best = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__n"), F.asc("snapshot_id")))).where("__r = 1")
    return rows.join(best.select(*by, "snapshot_id"), [*by, "snapshot_id"], "left_semi")


def snapshot_times(snapshots: DataFrame, start, end, closed_start: bool = False, closed_end: bool = True, time_col: str = "ts_us") -> DataFrame:
    t = F.col(time_col)
    return snapshots.where((t >= start if closed_start else t > start) & (t <= end if closed_end else t < end)).select("inst_id", time_col).distinct()


def write_book(df: DataFrame, path: str, mode: str = "append", compression: str = "snappy") -> None:
    """{path}/inst_id=/mode=/date=: Hive layout, so later scans prune by name."""
    (
        df.withColumn("mode", F.col("reconstruction_mode")).withColumn("date", F.to_date(F.timestamp_micros("ts_us")))
        .repartition("inst_id", "mode", "date").sortWithinPartitions("ts_us")
        .write.mode(mode).option("compression", compression).partitionBy("inst_id", "mode", "date").parquet(path)
    )


def write_chunk(df: DataFrame, path: str, chunk: str, compression: str = "snappy") -> None:
    """{path}/inst_id=/mode=/date=/chunk=: write_book's layout with the chunk below, of which a second write replaces what the first left."""
    (
        df.withColumns({"mode": F.col("reconstruction_mode"), "date": F.to_date(F.timestamp_micros("ts_us")), "chunk": F.lit(chunk)})
        .repartition("inst_id", "mode", "date").sortWithinPartitions("inst_id", "ts_us")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression)
        .partitionBy("inst_id", "mode", "date", "chunk").parquet(path)
    )


def read_book(spark: SparkSession, path: str, inst_id: str, start_us: int, end_us: int, mode: str | None = None) -> DataFrame:
    day = lambda us: F.to_date(F.timestamp_micros(F.lit(us)))
    df = spark.read.parquet(path).where((F.col("inst_id") == inst_id) & F.col("date").between(day(start_us), day(end_us)))
    df = df.where(F.col("ts_us").between(start_us, end_us))
    return df.where(F.col("mode") == mode) if mode else df


#: The end of a shard's file name: <date>_<HH-MM-SS>__<date>_<HH-MM-SS>.parquet
SHARD_NAME = r"_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})__(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.parquet$"


def shard_bounds(name: Column) -> tuple[Column, Column]:
    """(start, end) of a shard's file name as timestamps without a zone (UTC); NULL if it names none."""
    part = lambda i: F.try_to_timestamp(F.nullif(F.regexp_extract(name, SHARD_NAME, i), F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss")).cast("timestamp_ntz")
    return part(1), part(2)


def shard_overlaps(lo: Column, hi: Column, start: Column, end: Column, closed: bool = True) -> Column:
    """Whether [lo, hi] meets [start, end]; not closed: touching ends do not count."""
    return (lo <= end) & (hi >= start) if closed else (lo < end) & (hi > start)


def read_shards(spark: SparkSession, directory: str, inst_id: str, start_us: int, end_us: int, time_col: str = "ts_us", shared_edge: str = "once") -> DataFrame:
    """Rows in [start, end] of an instrument's shards (sources/shards.py) anywhere below a folder; only shards that overlap are read.

    Names are listed through Hadoop's file system and shards read by Spark, so any store will do. Rows of equal time all stay; those of
    the time at which two shards meet, which both hold, are taken from the later one (shared_edge `twice`: from both).
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, folders = [], [path]
    while folders:
        for s in system.listStatus(folders.pop()):
            if s.getPath().getName().endswith(".parquet"):
                listed.append(s.getPath().toString())
            elif s.isDirectory():
                folders.append(s.getPath())
    found = choose(listed, inst_id, start_us, end_us, shared_edge)
    if not found:
        raise FileNotFoundError(f"no shard of {inst_id} in {directory} overlaps")
    df = spark.read.parquet(*(s.path for s in found))
    kind = dict(df.dtypes)[time_col]
    micros = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, timestamp_ntz'1970-01-01 00:00:00')") if kind == "timestamp_ntz" else F.timestamp_micros(F.expr(c)) if kind == "timestamp" else F.expr(c)
    at = lambda us: micros(f"{us}L")
    kept = df.where(F.col(time_col).between(at(start_us), at(end_us)))  # a predicate on the column itself: row groups are pruned
    if edges := [s.hi for s in found if s.open_end]:
        end = F.to_timestamp_ntz(F.regexp_extract("_metadata.file_path", SHARD_NAME.replace("$", ""), 2), F.lit("yyyy-MM-dd_HH-mm-ss"))
        named = kept.withColumn("__hi", F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), end))
        kept = named.where(~(F.col("__hi").isin(edges) & F.col(time_col).eqNullSafe(micros("__hi")))).drop("__hi")
    return kept


def overlapping_bounds(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """(file, lo, hi) of the files of df whose own times overlap the range, for files whose names tell nothing."""
    per = df.groupBy(F.input_file_name().alias("file")).agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    return per.where(shard_overlaps(F.col("lo"), F.col("hi"), F.lit(start_us), F.lit(end_us)))


def export_sample(df: DataFrame, inst_id: str, path: str, start=None, end=None, depth: int = DEPTH) -> None:
    snapshot_scan(df, inst_id, start, end, depth).write.mode("overwrite").parquet(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report (bounded: at most `most` rows) as a Markdown table."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = [[cell(v) for v in r] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows])


def presence(df: DataFrame, by: Sequence[str] = ("inst_id",), time_col: str = "ts_us") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(time_col).alias("first_us"), F.max(time_col).alias("last_us"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("ts_event", "y_true", "y_pred", "y_proba_pos").write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """csv or json rows; structs become JSON text in csv."""
    if kind == "csv":
        nested = {c for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
        df = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)
