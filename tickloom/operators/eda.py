"""Exploratory features and summaries: order-flow proxies, liquidity, slopes, partial windows, pivots, market statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rowwise as R
from ..functions.bins import quantile_bin
from ..functions.quantiles import quantiles, with_quantiles
from ..functions.timewin import SECOND, ordered
from ..schema import float_divide, float_ln, ratio
from .stats import long_form


def _change(column: str, k: int = 1) -> Column:
    return F.col(column) - F.lag(column, k).over(ordered())


def filled(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def micro_features() -> dict[str, Column]:
    """Imbalance and microprice less mid filled with 0, the latter also in basis points, and the spread in basis points, both infinite at a mid of zero."""
    mid = F.col("mid_px")
    return {
        "imbalance_filled": filled(R.imbalance(1)), "microprice_diff": filled(R.microprice() - mid),
        "micro_minus_mid_bps": float_divide(R.microprice() - mid, mid) * 1e4, "spread_bps": float_divide(F.col("spread_px"), mid) * 1e4,
    }


def order_flow_proxy() -> dict[str, Column]:
    """Best-level flow from size changes: what joins the bid or leaves the ask buys, the mirror sells; ofi is 0 without flow."""
    zero = F.lit(0.0)
    bid, ask = filled(_change("bid_sz_01")), filled(_change("ask_sz_01"))
    buy = F.greatest(bid, zero) + F.greatest(-ask, zero)
    sell = F.greatest(ask, zero) + F.greatest(-bid, zero)
    return {"buy_flow": buy, "sell_flow": sell, "ofi": filled(ratio(buy - sell, buy + sell)), "liquidity_change": bid - ask}


def trend_features(rows: Sequence[int] = (50, 100, 300)) -> dict[str, Column]:
    """Log mid (minus infinity at zero), its slope over n rows (NULL before), and the share of the best sizes lost since the last row (NULL after size 0)."""
    w, y = ordered(), float_ln(F.col("mid_px"))
    out = {"log_mid": y} | {f"log_mid_slope_{n}": (y - F.lag(y, n).over(w)) / n for n in rows}
    return out | {f"{s}_size_drop_pct": -ratio(_change(f"{s}_sz_01"), F.lag(f"{s}_sz_01").over(w)) for s in ("bid", "ask")}


def lag_features(columns: Sequence[str], rows: Sequence[int]) -> dict[str, Column]:
    """Differences to k rows before."""
    return {f"{c}_diff_{k}": _change(c, k) for c in columns for k in rows}


def partial_windows(column: str = "mid_px", rows: Sequence[int] = (10, 50, 100, 300), tick: float | None = None, step_rows: int = 100) -> dict[str, Column]:
    """Windows that may be partial. pct_change_p; std of log returns over p rows from max(5, p // 10) values on (NaN where a value has come
    to zero, whose return is minus infinity; the return from zero is NULL); std of mid changes
    over 10 rows, 0 while unknown; with a tick, the std of changes in ticks over step_rows rows from max(2, step_rows // 4) values on."""
    w = ordered()
    x, back = F.col(column), F.lag(column).over(w)
    ret = float_ln(ratio(x, back))

    def std(value: Column, p: int, least: int) -> Column:
        frame = w.rowsBetween(1 - p, 0)
        return F.when(F.count(value).over(frame) >= least, F.stddev_samp(value).over(frame))

    out = {f"pct_change_{p}": ratio(_change(column, p), F.lag(column, p).over(w)) for p in rows}
    out |= {f"log_ret_std_{p}": std(F.col("__ret"), p, max(5, p // 10)) for p in rows}
    out["change_std_10"] = filled(std(F.col("__step"), 10, 10))
    if tick:
        out[f"tick_std_{step_rows}"] = std(F.col("__step") / tick, step_rows, max(2, step_rows // 4))
    return {"__ret": ret, "__step": x - back} | out


def with_partial_windows(df: DataFrame, **options) -> DataFrame:
    columns = partial_windows(**options)
    first = {c: columns.pop(c) for c in ("__ret", "__step")}
    return df.withColumns(first).withColumns(columns).drop(*first)


def persistence_seconds(df: DataFrame, condition: Column, out: str, most: float = 300.0, order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """df with `out`: rows of the current run of true conditions times the instrument's median gap in seconds, `most` at most."""
    over = ordered(order=order)
    gap = (F.col("ts_us") - F.lag("ts_us").over(over)) / SECOND
    dt = quantiles(df.select(F.col("inst_id").alias("__i"), gap.alias("g")), F.col("g"), [0.5], ["__i"]).select("__i", F.col("q")[0].alias("__dt"))
    hit = F.coalesce(condition, F.lit(False))
    rows = df.withColumn("__h", hit).withColumn("__g", F.sum(F.when(F.col("__h"), 0).otherwise(1)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count_if("__h").over(Window.partitionBy("inst_id", "__g").orderBy(*order))
    rows = rows.withColumn("__r", F.when(F.col("__h"), run).otherwise(0)).join(dt, F.col("inst_id").eqNullSafe(F.col("__i")), "left")
    return rows.withColumn(out, F.least(F.coalesce(F.col("__r") * F.col("__dt"), F.lit(0.0)), F.lit(most))).select(*df.columns, out)


def shift_target(rows: int = 2, column: str = "mid_px") -> dict[str, Column]:
    """Change after `rows` rows and its sign; NULL in the tail, which callers drop."""
    delta = F.lead(column, rows).over(ordered()) - F.col(column)
    return {"target_delta": delta, "target_sign": F.signum(delta).cast("int")}


def forward_returns(rows: Sequence[int] = (1, 10, 50), column: str = "mid_px") -> dict[str, Column]:
    return {f"fwd_ret_{k}": ratio(F.lead(column, k).over(ordered()), F.col(column)) - 1 for k in rows}


def future_reach(rows: int, ticks: Sequence[int], tick: float, column: str = "mid_px", tolerance: float = 1e-9) -> dict[str, Column]:
    """Greatest rise and fall in ticks over the next `rows` rows (fewer in the tail, NULL at its end) and whether each of `ticks` is reached."""
    frame = ordered().rowsBetween(1, rows)
    up = (F.max(column).over(frame) - F.col(column)) / tick
    down = (F.col(column) - F.min(column).over(frame)) / tick
    out = {"up_move_ticks": up, "down_move_ticks": down}
    for x in ticks:
        out |= {f"reached_{n}_{x}": F.coalesce(m >= x - tolerance, F.lit(False)).cast("int") for n, m in (("plus", up), ("minus", down))}
    return out


def every_nth(df: DataFrame, n: int, order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """Rows 0, n, 2n, ... of each instrument in order."""
    return df.withColumn("__n", F.row_number().over(ordered(order=order)) - 1).where(F.col("__n") % n == 0).drop("__n")


def first_slice(df: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows of each instrument up to `seconds` after its first."""
    start = df.groupBy(F.col("inst_id").alias("__i")).agg(F.min("ts_us").alias("__s"))
    return df.join(start, F.col("inst_id") == F.col("__i")).where(F.col("ts_us") <= F.col("__s") + seconds * SECOND).select(*df.columns)


def trim_lookback(df: DataFrame, column: str) -> DataFrame:
    """Rows whose longest look-back is whole, that is `column` is known."""
    return df.where(F.col(column).isNotNull())


def shocks(df: DataFrame, depth_change: str, imbalance: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with liquidity_shock (depth change at or below its `low` quantile) and imbalance_spike (abs at or above its `high` one)."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = with_quantiles(with_quantiles(df, F.col(depth_change), [low], out="__lo"), F.abs(F.col(imbalance)), [high], out="__hi", of=df)
    return rows.withColumns({"liquidity_shock": flag(F.col(depth_change) <= F.col("__lo")[0]), "imbalance_spike": flag(F.abs(F.col(imbalance)) >= F.col("__hi")[0])}).drop("__lo", "__hi")


def level_heat(long_rows: DataFrame, order: Sequence[str] = ("ts_us",), bucket: int = 3600 * SECOND) -> DataFrame:
    """Of level rows (inst_id, ts_us, side, level, size): log1p of the size, its share of the (time, side) total (0 if that is 0),
    its change since the level's last row in `order` (0 at first), and a dense time index from 0 an instrument.

    Windows lie within time buckets (microseconds), all on one shuffle; a bucket begins with the last size of each level and the number of times before it, from
    one row a bucket, side and level. Rows without a time are one bucket, the first."""
    rows = long_rows.withColumn("__b", F.coalesce(F.floor(F.col("ts_us") / bucket), F.lit(-(1 << 62))))
    at, slot = ("inst_id", "__b"), ("inst_id", "side", "level")
    ends = rows.groupBy(*at, "side", "level").agg(F.max_by(F.struct("size"), F.struct(*order)).alias("__last"))
    carry = ends.select(*(F.col(c).alias(f"__k_{c}") for c in (*slot, "__b")), F.lag("__last").over(Window.partitionBy(*slot).orderBy("__b")).alias("__carry"))
    times = rows.select(*at, "ts_us").distinct().groupBy(*at).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("inst_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = times.select(F.col("inst_id").alias("__t_inst_id"), F.col("__b").alias("__t___b"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = lambda prefix, keys: reduce(and_, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in keys))
    rows = rows.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*at).orderBy("ts_us")))
    rows = rows.withColumn("__total", F.sum("size").over(Window.partitionBy(*at, "ts_us", "side")))
    rows = rows.withColumn("__back", F.lag(F.struct("size")).over(Window.partitionBy(*at, "side", "level").orderBy(*order)))
    rows = rows.join(F.broadcast(carry), same("__k_", (*slot, "__b")), "left").join(F.broadcast(counts), same("__t_", at), "left")
    return rows.select(
        *long_rows.columns, F.log1p("size").alias("log_size"), filled(ratio(F.col("size"), F.col("__total"))).alias("size_share"),
        filled(F.col("size") - F.coalesce("__back", "__carry")["size"]).alias("size_diff"), (F.col("__rank") - 1 + F.col("__before")).cast("int").alias("ts_index"),
    )


def pivot_2d(df: DataFrame, a: str, b: str, y: str, q: int = 5, least: int = 10) -> DataFrame:
    """Mean of y by quantile bins of a (rows) and b (columns b0 ...); empty for under `least` rows with all three known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    binned = quantile_bin(quantile_bin(known, a, "bin_a", q), b, "bin_b", q, of=known)
    n = known.agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    wide = binned.groupBy("bin_a").pivot("bin_b", list(range(q))).agg(F.avg(y))
    return wide.crossJoin(F.broadcast(n)).select("bin_a", *(F.col(str(i)).alias(f"b{i}") for i in range(q)))


def basic_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: mean, std, min, max, percent above and below 0 (of all rows)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int")) * 100
    return long_form(df, columns).groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), share(F.col("x") > 0).alias("pct_pos"), share(F.col("x") < 0).alias("pct_neg"),
    )


def market_stats(df: DataFrame, returns: str) -> DataFrame:
    """Per instrument: rows, first and last time, mean mid and spread, and the 1, 50 and 99 % quantiles of the returns."""
    found = df.groupBy("inst_id").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.avg("mid_px").alias("mean_mid"), F.avg("spread_px").alias("mean_spread"))
    return with_quantiles(found, F.col(returns), [0.01, 0.5, 0.99], ["inst_id"], "__q", df).select("inst_id", "n", "first_us", "last_us", "mean_mid", "mean_spread", *(F.col("__q")[i].alias(f"ret_{n}") for i, n in enumerate(("p01", "p50", "p99"))))


def regime_summary(df: DataFrame, regime: str, wait_us: str) -> DataFrame:
    """Per regime: rows, share that reach the target, and the median wait in seconds of those."""
    found = df.groupBy(regime).agg(F.count("*").alias("n"), F.avg(F.col(wait_us).isNotNull().cast("int")).alias("share"))
    return with_quantiles(found, F.col(wait_us), [0.5], [regime], "__q", df).select(regime, "n", "share", (F.col("__q")[0] / SECOND).alias("median_s"))


def group_summary(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """A row a feature that df has, with its group: percent missing, mean, std, min, median, max."""
    from .stats import feature_summary

    have = [(g, c) for g, cs in groups.items() for c in cs if c in df.columns]
    names = df.sparkSession.createDataFrame(have, "group string, feature string")
    return feature_summary(df, list(dict.fromkeys(c for _, c in have))).join(F.broadcast(names), "feature")


def validity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: rows with and without a value (are the windows whole?)."""
    return long_form(df, columns).groupBy("feature").agg(F.count("x").alias("valid"), F.count_if(F.col("x").isNull()).alias("missing"))


def metric_join(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """(metric, value_<a>, value_<b>, diff) of two reports (metric, value), all metrics of both."""
    x, y = f"value_{name_a}", f"value_{name_b}"
    return a.select("metric", F.col("value").alias(x)).join(b.select("metric", F.col("value").alias(y)), "metric", "full").withColumn("diff", F.col(y) - F.col(x))


def stability_by_thirds(df: DataFrame, targets: Sequence[str], order: str = "ts_us") -> DataFrame:
    """(target, third, n, positive_rate) over thirds of the time span between the first and the last row, so nothing is sorted."""
    span = df.agg(F.min(order).alias("__a"), F.max(order).alias("__z"))
    third = F.least(F.floor((F.col(order) - F.col("__a")) * 3 / F.greatest(F.col("__z") - F.col("__a"), F.lit(1))), F.lit(2)).cast("int")
    rows = df.crossJoin(F.broadcast(span)).withColumn("third", third)
    return long_form(rows, targets, ("third",)).groupBy(F.col("feature").alias("target"), "third").agg(F.count("*").alias("n"), F.avg("x").alias("positive_rate"))


def reconcile_ticks(by_steps: DataFrame, by_levels: DataFrame, within: float = 0.2) -> DataFrame:
    """(inst_id, tick): the tick by steps if it is there and less than `within` of the tick by levels away from that, else the tick by levels."""
    a, b = by_steps.select("inst_id", F.col("tick").alias("__a")), by_levels.select("inst_id", F.col("tick").alias("__b"))
    close = F.coalesce(F.try_divide(F.abs(F.col("__a") - F.col("__b")), "__b") < within, F.lit(False))
    return a.join(b, "inst_id", "full").select("inst_id", F.when(close, F.col("__a")).otherwise(F.col("__b")).alias("tick"))


def first_with_tick(ticks_by_shard: DataFrame, order: str = "shard") -> DataFrame:
    """(inst_id, shard, tick) of the first shard whose tick is known."""
    return ticks_by_shard.where("tick is not null").groupBy("inst_id").agg(F.min(F.struct(order, "tick")).alias("f")).select("inst_id", "f.*")
