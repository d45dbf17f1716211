"""The carried replay against the interval join, in buckets of every size; values carried over buckets of time."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.timewin import SECOND, asof, carried_last
from tickloom.operators import book as B
from tickloom.operators.replay import Book, carried_replay, deal

CHANGES = "inst_id string, seg_us long, ts_us long, seq int, side string, price double, size double"


def plain(changes, emits, depth):
    """Sort, write, take the best levels: (segment, ts_us) to prices and sizes."""
    out = {}
    for inst, seg, t in emits:
        held = {}
        for c in sorted((c for c in changes if c[:2] == (inst, seg) and c[2] <= t), key=lambda c: c[2:4]):
            held[c[4], c[5]] = c[6]
        sides = []
        for side, turn in (("bid", -1), ("ask", 1)):
            best = sorted((turn * p, z) for (s, p), z in held.items() if s == side and z is not None and z > 0)[:depth]
            sides.append([(turn * p, z) for p, z in best])
        out[inst, seg, t] = sides
    return out


@pytest.mark.parametrize("bucket_rows", [1, 7, 100_000])
def test_carried_replay(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    changes = []
    for inst, seg in (("a", 0), ("a", 10_000 * SECOND), (None, 0), ("b", 5)):
        changes += [(inst, seg, seg + rng.randrange(0, 9000) * SECOND, k, rng.choice(["bid", "ask"]), float(rng.randrange(20)), rng.choice([0.0, 1.0, 2.5, None])) for k in range(120)]
    emits = sorted({(c[0], c[1], c[2] + rng.choice([-1, 0, 1])) for c in changes}, key=str) + [("c", 1, 1)]
    got = carried_replay(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(emits, "inst_id string, seg_us long, ts_us long"), 3, bucket_rows=bucket_rows)
    rows, want = got.collect(), plain(changes, emits, 3)
    assert len(rows) == len(want)
    for r in rows:
        for side, levels in zip(("bid", "ask"), want[r.inst_id, r.seg_us, r.ts_us], strict=True):
            levels = levels + [(None, None)] * (3 - len(levels))
            assert [(r[f"{side}_px_{i:02d}"], r[f"{side}_sz_{i:02d}"]) for i in (1, 2, 3)] == levels


def test_rows_grow_with_changes_not_with_rest(spark):
    """A level that rests for a year is dealt to as many buckets as changes make, not to each hour."""
    year = 365 * 24 * 3600 * SECOND
    changes = [("a", 0, 0, 0, "bid", 1.0, 1.0)] + [("a", 0, year + k, k, "ask", 2.0 + k, 1.0) for k in range(5)]
    emits = spark.createDataFrame([("a", 0, year + 9)], "inst_id string, seg_us long, ts_us long")
    got = carried_replay(spark.createDataFrame(changes, CHANGES), emits, 2, bucket_rows=3)
    assert [(r.bid_px_01, r.ask_px_01, r.ask_px_02) for r in got.collect()] == [(1.0, 2.0, 3.0)]
    dealt = deal(spark.createDataFrame(changes, CHANGES), emits, ("seq",), 3, B.SEGMENT)
    assert dealt.groupBy("kind").count().orderBy("kind").collect() == [(-1, 9), (0, 6), (1, 1)]  # three levels into the second bucket, six into the third


def test_book_of_lists():
    book = Book()
    for side, price, size in (("bid", 1.0, 1.0), ("bid", 3.0, 2.0), ("bid", 1.0, 0.0), ("none", 1.0, 1.0), ("ask", None, 1.0), ("ask", 5.0, 4.0), ("ask", 5.0, None), ("ask", 6.0, 1.0)):
        book.write(side, price, size)
    assert [x for x in book.best(2) if x == x] == [3.0, 2.0, 6.0, 1.0]


@pytest.mark.parametrize("back", [True, False])
def test_carried_last_against_one_window(spark, back):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), k, rng.choice([None, None, None, k])) for k in range(400)]
    df = spark.createDataFrame(rows, "inst_id string, t long, k int, v int")
    turn = F.asc if back else F.desc
    order = [turn("t"), turn("k")]
    want = df.withColumn("w", F.last("v", ignorenulls=True).over(Window.partitionBy("inst_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    got = carried_last(want, df, "v", "t", ["k"], order, "got", back=back, bucket=3)
    assert got.count() == 400 and got.where("not got <=> w").count() == 0


def test_asof_takes_all_tasks(spark):
    """One instrument: no window of an as-of lookup without reach holds more than an hour of it."""
    t = spark.range(1000).select(F.lit("a").alias("inst_id"), (F.col("id") * 600 * SECOND).alias("ts_us"), F.col("id").alias("event_id"))
    found = asof(t, t.where("event_id % 50 = 0"), F.col("ts_us"), F.col("ts_us"), F.col("event_id"))
    assert found.where("found = event_id div 50 * 50").count() == 1000
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(windows) == 2 and all("__at" in w for w in windows)
