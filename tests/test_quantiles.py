"""Percentiles by cells against the built-in ones."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions.quantiles import cell, quantiles, with_quantiles

POINTS = [0, 0.01, 0.25, 1 / 3, 0.5, 0.95, 1]


def same(a, b):
    return len(a) == len(b) and all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def test_groups_weights_and_nulls(spark):
    df = spark.range(20000).selectExpr(
        "case when id % 10 = 0 then null else id % 7 end as g", "case when id % 3 = 0 then null when id % 50 < 25 then cast(hash(id) as double) / 7 else 5.0 end as v", "1 + id % 4 as w"
    )
    got = {r.g: r.q for r in quantiles(df, F.col("v"), POINTS, ["g"], weight=F.col("w")).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", POINTS, F.col("w")).alias("q")).collect()}
    assert None in got and got == want
    assert quantiles(df, F.col("v"), POINTS).first().q == df.agg(F.percentile("v", POINTS)).first()[0]


def test_no_values(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "g int, v double")
    assert quantiles(df.where("false"), F.col("v"), [0.5]).collect() == [(None,)]
    assert quantiles(df.where("false"), F.col("v"), [0.5], ["g"]).collect() == []
    assert sorted(with_quantiles(df, F.col("v"), [0.5], ["g"]).collect()) == [(1, None, None), (2, 3.0, [3.0])]


def test_cells_rise(spark):
    values = [-math.inf, -1e300, -2.0, -1.0000001, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000001, 2.0, 1e300, math.inf, math.nan]
    found = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(cell(F.col("v")).alias("c")).collect()]
    assert found == sorted(found)


def test_any_doubles(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.floats(), min_size=1, max_size=40))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert same(quantiles(df, F.col("v"), [0, 0.3, 1]).first().q, df.agg(F.percentile("v", [0, 0.3, 1])).first()[0])

    check()
