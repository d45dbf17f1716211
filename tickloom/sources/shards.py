"""Hourly shards {base}/{inst}/{mode}/{date}/<prefix>_<mode>_<inst>_<start>__<end>.parquet: a writer and a data source that reads a range of time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HOUR_US = 3_600_000_000
#: How the two times at the end of a shard's name are written.
STAMP = "%Y-%m-%d_%H-%M-%S"
_NAME = re.compile(r"(?P<head>[^/]*)_(?P<lo>\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})__(?P<hi>\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.parquet$")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Shard(NamedTuple):
    """A shard by its name: times in microseconds; open_end: the next shard begins where this one ends, and holds the rows of that time."""

    path: str
    lo: int
    hi: int
    open_end: bool


def _micros(stamp: str) -> int:
    return (datetime.strptime(stamp, STAMP).replace(tzinfo=timezone.utc) - _EPOCH) // timedelta(microseconds=1)


def _stamp(us: int) -> str:
    return (_EPOCH + timedelta(microseconds=us)).strftime(STAMP)


def choose(paths: list[str], inst_id: str, start_us: int, end_us: int, shared_edge: str = "once") -> list[Shard]:
    """The shards of an instrument whose closed range meets [start_us, end_us], in order of time. Names may have any prefix; what is no
    shard's name or another instrument's is passed over. shared_edge: two shards that meet both hold the rows of that time; `once` leaves
    them to the later one, `twice` gives both."""
    if shared_edge not in ("once", "twice"):
        raise ValueError(f"unknown shared_edge {shared_edge!r}")
    if end_us < start_us:
        raise ValueError("the range ends before it starts")
    found = []
    for path in paths:
        m = _NAME.search(path)
        if m and (m["head"] == inst_id or m["head"].endswith(f"_{inst_id}")):
            lo, hi = _micros(m["lo"]), _micros(m["hi"])
            if hi >= start_us and lo <= end_us:
                found.append((lo, hi, path))
    found.sort()
    begins = {lo for lo, _, _ in found}
    return [Shard(path, lo, hi, shared_edge == "once" and hi in begins and lo < hi) for lo, hi, path in found]


def _readable(field: pa.Field) -> pa.Field:
    """Times in nanoseconds, as pandas writes them, become microseconds, which Spark has."""
    return field.with_type(pa.timestamp("us", field.type.tz)) if pa.types.is_timestamp(field.type) else field


class _Range(InputPartition):
    def __init__(self, shard: Shard):
        self.shard = shard


class ShardSource(DataSource):
    """`spark.read.format("book_shards")`: the rows of an instrument in a closed range of time, one input partition a shard.

    Options: path (a URI that pyarrow's file systems open on every node), inst_id, start_us, end_us; mode (a folder below the instrument's;
    without it all are read), time_col (ts_event: a timestamp, or a number of microseconds), columns (comma list, else all), shared_edge
    (see choose). Folders are listed recursively below the instrument's. Shards outside the range are not opened, row groups outside it not
    read. Rows of equal time all stay; rows without a time go. No shard in the range is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "book_shards"

    def _open(self):
        from pyarrow import fs

        o = self.options
        store, base = fs.FileSystem.from_uri(o["path"])
        folder = "/".join(x for x in (base.rstrip("/"), o["inst_id"], o.get("mode", "")) if x)
        files = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        found = choose([f.path for f in files if f.is_file], o["inst_id"], int(o["start_us"]), int(o["end_us"]), o.get("shared_edge", "once"))
        if not found:
            raise FileNotFoundError(f"no shard below {folder} meets [{_stamp(int(o['start_us']))}, {_stamp(int(o['end_us']))}]")
        return store, found

    def _arrow_schema(self) -> pa.Schema:
        import pyarrow.parquet as pq

        store, found = self._open()
        with store.open_input_file(found[0].path) as f:
            schema = pq.read_schema(f)
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else schema.names
        return pa.schema([_readable(schema.field(c)) for c in names])

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._arrow_schema())

    def reader(self, schema) -> DataSourceReader:
        return _ShardReader(self, schema)


class _ShardReader(DataSourceReader):
    def __init__(self, source: ShardSource, schema):
        self.options, self.names, self.found = dict(source.options), schema.fieldNames(), source._open()[1]

    def partitions(self) -> list[InputPartition]:
        return [_Range(s) for s in self.found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        shard, time_col = partition.shard, self.options.get("time_col", "ts_event")
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        data = ds.dataset(shard.path, filesystem=store, format="parquet")
        kind = data.schema.field(time_col).type
        at = lambda us: pa.scalar(us, pa.timestamp("us", getattr(kind, "tz", None))).cast(kind) if pa.types.is_timestamp(kind) else pa.scalar(us, kind)
        time = ds.field(time_col)
        wanted = (time >= at(int(self.options["start_us"]))) & (time <= at(int(self.options["end_us"])))
        if shard.open_end:
            wanted &= time < at(shard.hi)
        for batch in data.to_batches(columns=self.names, filter=wanted):
            yield batch.cast(pa.schema([_readable(f) for f in batch.schema]), safe=False)


def read_shards_of(
    spark: SparkSession, base: str, inst_id: str, start_us: int, end_us: int, mode: str | None = None, columns: list[str] | None = None, **options: str
) -> DataFrame:
    """ShardSource, registered and read."""
    spark.dataSource.register(ShardSource)
    given = {"path": base, "inst_id": inst_id, "start_us": start_us, "end_us": end_us, "mode": mode, "columns": columns and ",".join(columns)} | options
    return spark.read.format("book_shards").options(**{k: v for k, v in given.items() if v is not None}).load()


def write_shards(df: DataFrame, base: str, mode: str, hours: int = 1, prefix: str = "book", time_col: str = "ts_event") -> DataFrame:
    """Write df (inst_id, time_col, ...) as shards of `hours`, counted from midnight, below `base`, a URI all nodes share; (path, rows) of each,
    written when these rows are read. A shard holds the rows of [start, end) in order of time. It is written under its attempt's name and
    then renamed, so a task or job that runs again replaces its shards."""
    step = hours * HOUR_US
    us = F.unix_micros(F.col(time_col)) if dict(df.dtypes)[time_col] == "timestamp" else F.unix_micros(F.col(time_col).cast("timestamp"))
    dealt = df.where(F.col(time_col).isNotNull()).withColumn("__lo", F.floor(us / step) * step)
    dealt = dealt.repartition("inst_id", "__lo").sortWithinPartitions("inst_id", "__lo", time_col)
    names, inst_at = df.columns, df.columns.index("inst_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        now, sink, path, rows, done = None, None, "", 0, []
        attempt = f"_attempt-{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            sink.close()
            store.move(f"{path.rpartition('/')[0]}/{attempt}", path)
            done.append((path, rows))

        for batch in batches:
            keys = list(zip(batch.column(inst_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True))
            begin = 0
            while begin < len(keys):
                end = begin
                while end < len(keys) and keys[end] == keys[begin]:
                    end += 1
                part = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names=names).slice(begin, end - begin)
                if keys[begin] != now:
                    if sink:
                        close()
                    now, rows = keys[begin], 0
                    inst, lo = now
                    folder = f"{root.rstrip('/')}/{inst}/{mode}/{_stamp(lo)[:10]}"
                    store.create_dir(folder, recursive=True)
                    path = f"{folder}/{prefix}_{mode}_{inst}_{_stamp(lo)}__{_stamp(lo + step)}.parquet"
                    sink = pq.ParquetWriter(f"{folder}/{attempt}", part.schema, filesystem=store)
                sink.write_batch(part)
                rows, begin = rows + part.num_rows, end
        if sink:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "rows"])

    return dealt.mapInArrow(run, "path string, rows bigint")
