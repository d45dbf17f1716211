"""Steps that must not grow faster than the input: replays without a join of times, ranks and alignment without one task an instrument."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions.ranged import with_average_rank_pct_by
from tickloom.functions.timewin import SECOND, average_rank_pct, time_bucket
from tickloom.operators import book as B, labels
from tickloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def per_instrument(df):
    """Window partitions of the plan that are an instrument alone, over rows rather than totals of buckets."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return re.findall(r"windowspecdefinition\(inst_id#\d+, (?:ts_us|value)#", plan)


@pytest.mark.parametrize("name", ["book_event_states", "book_grid_states", "snapshot_replay_validation"])
def test_replays_join_no_times(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("joins every time with every interval of its bucket")

    monkeypatch.setattr(B, "states", never)
    assert QUERIES[name](spark, SF).count() > 0


def test_wide_comparison_equals_that_of_levels(spark):
    rng = random.Random(4)

    def books(n, name):
        price, size = lambda: rng.choice([None, 1.0, 1.5, 2.0]), lambda: rng.choice([None, 0.0, 1.0, 2.0, 3.0])
        cols = [f"{s}_{w}_{i:02d}" for s in ("bid", "ask") for i in (1, 2) for w in ("px", "sz")]
        rows = [(rng.choice(["a", "b"]) if name == "real" else "ab"[k % 2], rng.randrange(40) if name == "real" else k // 2, *(price() if "px" in c else size() for c in cols)) for k in range(n)]
        return spark.createDataFrame(rows, "inst_id string, ts_us long, " + ", ".join(f"{c} double" for c in cols))

    real, rec = books(120, "real"), books(70, "rec")
    want = B.compare_levels(B.wide_to_levels(real, depth=2), B.wide_to_levels(rec, depth=2)).drop("n_compared")
    got = B.compare_wide(real, rec, depth=2).select(*want.columns)
    keep = [c for c in want.columns if not c.startswith("negative")]  # no level has such a size on either way
    assert got.select(keep).exceptAll(want.select(keep)).count() == 0 and want.select(keep).exceptAll(got.select(keep)).count() == 0


def test_ranks_within_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, 1.0, 2.0, 2.5, 7.0])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    got = {r.k: r.pct for r in with_average_rank_pct_by(df, "x", ["g"]).collect()}
    want = {r.k: r.pct for r in df.withColumn("pct", average_rank_pct("x", ("g",))).collect()}
    assert got == want
    assert not per_instrument(QUERIES["pct_rank_ties"](spark, SF))


@pytest.mark.parametrize("name", ["alignment_counts", "tick_direction_targets"])
def test_alignment_deals_by_time(spark, name):
    assert not per_instrument(QUERIES[name](spark, SF))


def test_grid_share_across_buckets(spark):
    """Gaps into the next hour count, empty hours too."""
    rows = [("a", t * 1800 * SECOND) for t in (0, 1, 2, 3, 9, 10)] + [("a", 0), ("b", 5)]
    r = {x.inst_id: x.share for x in labels.grid_regularity(spark.createDataFrame(rows, "inst_id string, ts_us long"), 1800 * SECOND).collect()}
    assert r == {"a": 4 / 5, "b": None}


def test_bucket_fits_the_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("ts_us"))
    assert time_bucket(df, rows=100) == 100 and time_bucket(df.where("false")) == 3600 * SECOND and time_bucket(df, rows=100, most=7) == 7
