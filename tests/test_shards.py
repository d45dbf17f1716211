"""Shards by name, the data source, repeated times and shared edges; the resumable reconstruction."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book as B
from tickloom.sources import shards, tables

HOUR = shards.HOUR_US
BASE = 1_700_000_000_000_000 // HOUR * HOUR


def rows(spark):
    """Three hours of two instruments, times repeated, one of them at the border of two hours."""
    seconds = [0, 5, 5, 1800, 3599, 3600, 3600, 5400, 7200, 9000]
    df = spark.createDataFrame([(i, BASE + s * 1_000_000, k) for i in ("X-1", "X-1-2") for k, s in enumerate(seconds)], "inst_id string, us long, k int")
    return df.select("inst_id", F.timestamp_micros("us").alias("ts_event"), "k")


def test_written_shards_are_read_by_both_readers(spark, tmp_path):
    base, df = str(tmp_path / "b"), rows(spark)
    made = shards.write_shards(df, base, "grid100ms").collect()
    assert sum(r.rows for r in made) == 20 and len(made) == 6
    assert all("/X-1/grid100ms/2023-" in r.path or "/X-1-2/grid100ms/2023-" in r.path for r in made)
    start, end = BASE + 5_000_000, BASE + 5400 * 1_000_000
    want = sorted(df.where(f"inst_id = 'X-1' and unix_micros(ts_event) between {start} and {end}").collect(), key=str)
    got = shards.read_shards_of(spark, base, "X-1", start, end, "grid100ms")
    assert sorted(got.collect(), key=str) == want and len(want) == 7
    assert got.rdd.getNumPartitions() == 2  # the third hour is not opened
    assert sorted(tables.read_shards(spark, base, "X-1", start, end, "ts_event").collect(), key=str) == want
    assert shards.read_shards_of(spark, base, "X-1", start, end, columns=["k"]).columns == ["k"]
    shards.write_shards(df, base, "grid100ms").collect()  # again: replaced, not added
    assert shards.read_shards_of(spark, base, "X-1", start, end).count() == 7
    with pytest.raises(Exception, match="no shard below"):
        shards.read_shards_of(spark, base, "X-2", start, end).count()


def test_shards_that_share_an_edge(spark, tmp_path):
    base, df = str(tmp_path / "b"), rows(spark).where("inst_id = 'X-1'")
    for h in range(3):  # closed at both ends, in folders of any depth, with a prefix of any kind
        lo, hi = BASE + h * HOUR, BASE + (h + 1) * HOUR
        part = df.where(f"unix_micros(ts_event) between {lo} and {hi}").toPandas()
        for top, unit in (("b", None), ("c", "us")):  # nanoseconds too, which only the data source reads
            folder = tmp_path / top / "X-1" / f"d{h}" / "e"
            folder.mkdir(parents=True)
            part.to_parquet(folder / f"any{h}_X-1_{shards._stamp(lo)}__{shards._stamp(hi)}.parquet", coerce_timestamps=unit)
    (tmp_path / "b" / "X-1" / "note.parquet").write_text("no shard")
    for edge, n in (("once", 10), ("twice", 13)):
        assert shards.read_shards_of(spark, base, "X-1", BASE, BASE + 3 * HOUR, shared_edge=edge).count() == n
        assert tables.read_shards(spark, str(tmp_path / "c"), "X-1", BASE, BASE + 3 * HOUR, "ts_event", edge).count() == n
    assert [s.open_end for s in shards.choose([f"a_X-1_{shards._stamp(BASE + a * HOUR)}__{shards._stamp(BASE + b * HOUR)}.parquet" for a, b in ((2, 3), (0, 1), (1, 2), (5, 6))], "X-1", BASE, BASE + 9 * HOUR)] == [True, True, False, False]
    with pytest.raises(ValueError):
        shards.choose([], "X-1", 2, 1)


def book_inputs(spark):
    opening = [("a", 0, s, p, 1.0) for s, p in (("bid", 99.0), ("ask", 101.0))] + [("late", 60, "bid", 5.0, 1.0), ("idle", 0, "bid", 7.0, 1.0)]
    deltas = [("a", 3, 1, "bid", 99.5, 2.0), ("a", 3, 2, "bid", 99.5, 4.0), ("a", 70, 3, "ask", 100.5, 1.0), ("late", 20, 4, "bid", 5.5, 1.0), ("late", 130, 5, "bid", 5.5, 1.0)]
    return (
        spark.createDataFrame(opening, "inst_id string, ts_us long, side string, price double, size double"),
        spark.createDataFrame(deltas, "inst_id string, ts_us long, seq int, side string, price double, size double"),
    )


def test_stopped_job_goes_on(spark, tmp_path, monkeypatch):
    opening, deltas = book_inputs(spark)
    ranges, whole, path = [(0, 50), (50, 100), (100, 150)], str(tmp_path / "whole"), str(tmp_path / "b")
    shape = lambda p: sorted(map(str, spark.read.parquet(p).collect()))
    report = B.reconstruct_job(opening, deltas, whole, ranges)
    status = {(r.start_us, r.inst_id): r.status for r in report.collect()}
    assert status[0, "a"] == "written" and status[0, "late"] == status[50, "late"] == "no anchor" and status[100, "late"] == "written" and status[100, "a"] == status[0, "idle"] == "no deltas"
    assert {r.n_rows for r in report.where("status = 'no anchor'").collect()} == {0}
    calls, original = [], tables.write_chunk

    def failing(df, path, chunk, *a):
        calls.append(chunk)
        original(df, path, chunk, *a)
        if len(calls) == 2:
            raise RuntimeError("killed after the rows, before the manifest")

    monkeypatch.setattr(tables, "write_chunk", failing)
    with pytest.raises(RuntimeError):
        B.reconstruct_job(opening, deltas, path, ranges)
    again = B.reconstruct_job(opening, deltas, path, ranges)
    assert calls == ["0-50", "50-100", "50-100", "100-150"]  # the first chunk is not done again
    assert shape(path) == shape(whole) and sorted(map(str, again.collect())) == sorted(map(str, report.collect()))
    B.reconstruct_job(opening, deltas, path, ranges)
    assert len(calls) == 4 and shape(path) == shape(whole)
