"""Snapshots replayed as they are against the replay of the changes that they stand for."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import book as B
from tickloom.operators.replay import carried_replay, leftovers, snapshot_replay
from tickloom.plans import queries as Q
from tickloom.schema import SIDES, level

DEPTH = 3
NAMES = [level(s, w, i) for s in SIDES for w in ("px", "sz") for i in range(1, DEPTH + 1)]


def books(spark, rng, n, times, prices):
    price = lambda: rng.choice([None, *(float(rng.randrange(prices)) for _ in range(9))])
    size = lambda: rng.choice([None, 0.0, *(float(rng.randrange(1, 5)) for _ in range(6))])
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *(rng.randrange(times) for _ in range(30))]), k, *(price() if "_px_" in c else size() for c in NAMES)) for k in range(n)]
    return spark.createDataFrame(rows, "inst_id string, ts_us long, event_id long, " + ", ".join(f"{c} double" for c in NAMES))


def by_changes(df):
    """The book at each time by carried_replay: a row's levels are set at its time and end at the next row's."""
    rows = df.where("inst_id is not null").withColumn("nxt", F.lead("ts_us").over(Window.partitionBy("inst_id").orderBy("ts_us", "event_id")))
    every = F.array(*(F.struct(F.lit(s).alias("side"), F.col(level(s, "px", i)).alias("price"), F.col(level(s, "sz", i)).alias("size")) for s in SIDES for i in range(1, DEPTH + 1)))
    one = lambda at, seq, size: rows.where(f"{at} is not null").select("inst_id", F.col(at).alias("ts_us"), F.explode(every).alias("l")).select("inst_id", "ts_us", F.lit(seq).alias("seq"), "l.side", "l.price", size.alias("size"))
    both = one("ts_us", 1, F.col("l.size")).unionByName(one("nxt", 0, F.lit(0.0)))
    changes = both.groupBy("inst_id", "ts_us", "side", "price").agg(F.max(F.struct("seq", "size")).alias("w")).select("inst_id", F.lit(0).alias("seg_us"), "ts_us", "side", "price", "w.*")
    rec = carried_replay(changes, rows.where("ts_us is not null").select("inst_id", F.lit(0).alias("seg_us"), "ts_us").distinct(), DEPTH)
    return {(x.inst_id, x.ts_us): [x[c] for c in NAMES] for x in rec.collect()}


@pytest.mark.parametrize(("times", "prices", "bucket", "batch"), [(30, 6, 7, 5), (80, 15, 25, 1), (400, 60, 1, 1000), (400, 12, 1000, 50)])
def test_snapshots_against_changes(spark, times, prices, bucket, batch):
    """Equal times, times of one row, batches and buckets that end between and within times."""
    df = books(spark, random.Random(times + bucket), 160, times, prices)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = snapshot_replay(df, DEPTH, bucket=bucket).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    own, want = {x.event_id: x for x in df.collect()}, by_changes(df)
    assert len(got) == len(own)
    for x in got:
        assert [x[c] for c in df.columns] == list(own[x.event_id])
        assert [x["rec_" + c] for c in NAMES] == want.get((x.inst_id, x.ts_us), [None] * len(NAMES))


def test_rows_travel_once(spark, monkeypatch):
    """No row is taken apart into the changes that it stands for, and nothing is carried where no times are equal."""

    def never(*_, **__):
        raise AssertionError("makes 40 changes of a row")

    monkeypatch.setattr(Q, "carried_replay", never)
    assert Q.QUERIES["snapshot_replay_validation"](spark, "/root/testdata/sf0.001").count() > 0
    df = books(spark, random.Random(1), 50, 10**9, 20).withColumn("bucket", F.lit(0))
    assert leftovers(df.where("ts_us is not null").dropDuplicates(["inst_id", "ts_us"]), DEPTH, ("ts_us", "event_id")) is None


def test_paired_comparison_equals_that_of_a_join(spark):
    df = books(spark, random.Random(3), 80, 10**9, 20).where("inst_id is not null and ts_us is not null").dropDuplicates(["inst_id", "ts_us"]).localCheckpoint()
    rec = df.select("inst_id", "ts_us", *((F.col(c) + F.col("event_id") % 3 - 1).alias(c) for c in NAMES))
    paired = df.join(rec.withColumnsRenamed({c: "rec_" + c for c in NAMES}), ["inst_id", "ts_us"])
    want, got = B.compare_wide(df, rec, depth=DEPTH), B.compare_paired(paired, depth=DEPTH)
    assert want.count() > 50 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
