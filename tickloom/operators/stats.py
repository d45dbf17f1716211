"""Diagnostics, tick size, resampling, regimes, conditional and extreme-event statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles, with_quantiles
from ..functions.timewin import SECOND, ordered


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(*keep, F.explode(items).alias("__i")).select(*keep, "__i.feature", "__i.x")


def diagnostics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row a column: mean, std, null_count, min, max. Default: columns named bid_, ask_, mid_ or spread_."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c.startswith(("bid_", "ask_", "mid_", "spread_"))]
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, mean double, std double, null_count bigint, min double, max double")
    return long_form(df, columns).groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count_if(F.col("x").isNull()).alias("null_count"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = long_form(df, columns)
    found = rows.groupBy("feature").agg((F.avg(F.col("x").isNull().cast("int")) * 100).alias("null_pct"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return with_quantiles(found, F.col("x"), [0.5], ["feature"], "__q", rows).select("feature", "null_pct", "mean", "std", "min", F.col("__q")[0].alias("median"), "max")


def book_quality(df: DataFrame, sizes: Sequence[str], by: Sequence[str] = ("inst_id",)) -> DataFrame:
    any_ = lambda test: reduce(lambda a, b: a | b, (F.coalesce(test(F.col(c)), F.lit(False)) for c in sizes))
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), (F.count("*") - F.countDistinct("ts_us")).alias("duplicate_times"), F.count_if(any_(lambda c: c < 0)).alias("negative_size_rows"),
        F.count_if(any_(lambda c: c <= 0)).alias("empty_size_rows"), F.count_if(F.coalesce(F.col("bid_px_01") >= F.col("ask_px_01"), F.lit(False))).alias("crossed_rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("mid_px", "spread_px")),
    )


def dedup(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    over = Window.partitionBy(*by).orderBy(*(F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order))
    return df.withColumn("__r", F.row_number().over(over)).where("__r = 1").drop("__r")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))).limit(n)


def gap_stats(df: DataFrame, limits_s: Sequence[float], by: Sequence[str] = ("inst_id",)) -> DataFrame:
    gap = (F.col("ts_us") - F.lag("ts_us").over(ordered())) / SECOND
    rows = df.select(*by, gap.alias("gap"))
    shares = {f"share_over_{s:g}": F.avg(F.when(F.col("gap").isNotNull(), (F.col("gap") > s).cast("int"))) for s in limits_s}
    found = rows.groupBy(*by).agg(F.count("*").alias("__n"), *(c.alias(n) for n, c in shares.items()))
    return with_quantiles(found, F.col("gap"), [0.5, 0.95], by, "__q", rows).select(*by, F.col("__q")[0].alias("median_gap"), F.col("__q")[1].alias("p95_gap"), *shares)


def tick_size(df: DataFrame, price: str, by: Sequence[str] = ("inst_id",), low: float = 0.01) -> DataFrame:
    """(by, tick): the most frequent (least of equals) positive step between rows, of those at or below their `low` quantile; to 8 places."""
    step = F.bround(F.abs(F.col(price) - F.lag(price).over(ordered())), 8)
    steps = df.select(*by, step.alias("step")).where("step > 0").groupBy(*by, "step").agg(F.count("*").alias("n"))
    limit = quantiles(steps, F.col("step"), [low], by, weight=F.col("n")).withColumn("q", F.col("q")[0])
    best = Window.partitionBy(*by).orderBy(F.desc("n"), "step")
    return steps.join(limit, list(by)).where("step <= q").withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*by, F.col("step").alias("tick"))


def tick_size_levels(df: DataFrame, price: str, by: Sequence[str] = ("inst_id",), low: float = 0.001, digits: int = 12) -> DataFrame:
    """(by, tick): the least difference between neighbouring distinct prices (to `digits` places) at or above their `low` quantile and 1e-12."""
    prices = df.select(*by, F.bround(price, digits).alias("p")).distinct()
    step = prices.withColumn("d", F.col("p") - F.lag("p").over(Window.partitionBy(*by).orderBy("p"))).where("d > 1e-12")
    limit = quantiles(step, F.col("d"), [low], by).withColumn("q", F.col("q")[0])
    return step.join(limit, list(by)).where("d >= q").groupBy(*by).agg(F.min("d").alias("tick"))


def resample_last(df: DataFrame, columns: Sequence[str], step_us: int, by: Sequence[str] = ("inst_id",), order: Sequence[str] = ("ts_us", "event_id"), empty: bool = True) -> DataFrame:
    """(by, bucket_us, columns): the last value that is not NULL in each step; empty steps between an instrument's ends are rows of NULL."""
    bucket = F.floor(F.col("ts_us") / step_us) * step_us
    key = F.struct(*order)
    last = df.groupBy(*by, bucket.alias("bucket_us")).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns))
    if not empty:
        return last
    grid = last.groupBy(*by).agg(F.min("bucket_us").alias("a"), F.max("bucket_us").alias("z")).select(*by, F.explode(F.sequence("a", "z", F.lit(step_us))).alias("bucket_us"))
    return grid.join(last, [*by, "bucket_us"], "left")


def bucket_profile(df: DataFrame, columns: Sequence[str], step_us: int, by: Sequence[str] = ("inst_id",)) -> DataFrame:
    bucket = F.floor(F.col("ts_us") / step_us) * step_us
    return df.groupBy(*by, bucket.alias("bucket_us")).agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def conditional_probabilities(df: DataFrame, conditions: dict[str, Column], target: Column) -> DataFrame:
    """(condition, n, p, baseline) of each named condition, in one pass."""
    hit = F.coalesce(target, F.lit(False)).cast("int")
    items = F.array(*(F.struct(F.lit(n).alias("condition"), F.coalesce(c, F.lit(False)).alias("on")) for n, c in conditions.items()))
    rows = df.select(hit.alias("y"), F.explode(items).alias("c"))
    return rows.groupBy("c.condition").agg(F.count_if("c.on").alias("n"), F.avg(F.when(F.col("c.on"), F.col("y"))).alias("p"), F.avg("y").alias("baseline"))


def extreme_events(df: DataFrame, column: str, quantile: float, values: Sequence[str]) -> DataFrame:
    """Rows with abs(column) at or above its quantile: their number and the means of values. The quantile is one broadcast row."""
    rows = with_quantiles(df, F.abs(F.col(column)), [quantile], out="__q")
    return rows.where(F.abs(F.col(column)) >= F.col("__q")[0]).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def median_regimes(df: DataFrame, column: str, low: str = "low", high: str = "high", out: str = "regime") -> DataFrame:
    middle = F.col("__q")[0]
    return with_quantiles(df, F.col(column), [0.5], out="__q").withColumn(out, F.when(F.col(column) <= middle, low).when(F.col(column) > middle, high)).drop("__q")


def regime_stats(df: DataFrame, regime: str, value: str) -> DataFrame:
    return df.groupBy(regime).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(F.abs(F.col(value))).alias("mean_abs"), F.stddev_samp(value).alias("std"))


def depth_profile(df: DataFrame, depth: int = 10) -> DataFrame:
    """(side, level, avg_size, cum_size)."""
    rows = long_form(df, [f"{s}_sz_{i:02d}" for s in ("bid", "ask") for i in range(1, depth + 1)]).groupBy("feature").agg(F.avg("x").alias("avg_size"))
    rows = rows.select(F.substring("feature", 1, 3).alias("side"), F.substring("feature", 8, 2).cast("int").alias("level"), "avg_size")
    return rows.withColumn("cum_size", F.sum("avg_size").over(Window.partitionBy("side").orderBy("level")))


def occurrence_join(a: DataFrame, b: DataFrame, keys: Sequence[str], order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Inner join on keys (NULL equals NULL) that pairs the i-th row of a key on one side with the i-th on the other."""
    left = a.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_a)))
    right = b.withColumn("__m", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_b)))
    right = right.select(*(F.col(k).alias(f"__{k}") for k in keys), "__m", *(c for c in b.columns if c not in keys))
    on = reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[f"__{k}"]) for k in keys)) & (left["__n"] == right["__m"])
    return left.join(right, on).drop("__n", "__m", *(f"__{k}" for k in keys))


def survival(df: DataFrame, wait_us: str, horizons_s: Sequence[int]) -> DataFrame:
    """(horizon_s, share): share of all rows, unknown tails too, whose wait is at most the horizon."""
    rows = df.select(wait_us, F.explode(F.array(*map(F.lit, horizons_s))).alias("horizon_s"))
    return rows.groupBy("horizon_s").agg(F.avg(F.coalesce(F.col(wait_us) <= F.col("horizon_s").cast("bigint") * SECOND, F.lit(False)).cast("int")).alias("share"))


def reach_table(df: DataFrame, waits: Sequence[str], horizons_s: Sequence[int]) -> DataFrame:
    """Reached share by horizon (rows) and wait column (columns)."""
    rows = df.select(*waits, F.explode(F.array(*map(F.lit, horizons_s))).alias("horizon_s"))
    return rows.groupBy("horizon_s").agg(*(F.avg(F.coalesce(F.col(w) <= F.col("horizon_s").cast("bigint") * SECOND, F.lit(False)).cast("int")).alias(w) for w in waits))


def passage_summary(df: DataFrame, waits: Sequence[str]) -> DataFrame:
    rows, points = long_form(df, waits), (0.5, 0.75, 0.9)
    found = rows.groupBy("feature").agg(F.avg(F.col("x").isNotNull().cast("int")).alias("share"))
    return with_quantiles(found, F.col("x"), points, ["feature"], "__q", rows).select("feature", "share", *((F.col("__q")[i] / SECOND).alias(f"p{round(100 * p)}_s") for i, p in enumerate(points)))
