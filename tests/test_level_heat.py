"""Level rows dealt by time buckets against windows over whole instruments."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import eda
from tickloom.plans.queries import QUERIES


@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_buckets_against_whole_instruments(spark, bucket):
    rng = random.Random(bucket)
    times = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(60), rng.randrange(60)]), k) for k in range(120)]
    rows = [(i, t, k, side, level, rng.choice([None, 0.0, 1.0, 2.5, 7.0])) for i, t, k in times for side in ("bid", "ask") for level in (1, 2, 3) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "inst_id string, ts_us long, event_id long, side string, level int, size double").localCheckpoint()
    change = F.col("size") - F.lag("size").over(Window.partitionBy("inst_id", "side", "level").orderBy("ts_us", "event_id"))
    total = F.sum("size").over(Window.partitionBy("inst_id", "ts_us", "side"))
    want = df.select(
        *df.columns, F.log1p("size").alias("log_size"), F.coalesce(F.col("size") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("size_share"),
        F.coalesce(change, F.lit(0.0)).alias("size_diff"), (F.dense_rank().over(Window.partitionBy("inst_id").orderBy("ts_us")) - 1).alias("ts_index"),
    )
    got = eda.level_heat(df, ("ts_us", "event_id"), bucket=bucket)
    assert got.columns == want.columns and got.count() == len(rows)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_window_is_an_instrument(spark):
    plan = QUERIES["level_heat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert not re.findall(r"windowspecdefinition\(inst_id#\d+, (?:side#\d+, level#\d+, )?ts_us#", plan)
