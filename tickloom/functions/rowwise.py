"""Row-wise book features: each function gives a Column (or a dict of named Columns) over the level columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEPTH, level, levels, ratio, require, safe_divide


def _sum(columns: list[str], skip_null: bool) -> Column:
    return reduce(add, (F.coalesce(F.col(c), F.lit(0.0)) if skip_null else F.col(c) for c in columns))


def spread() -> Column:
    return F.col("ask_px_01") - F.col("bid_px_01")


def relative_spread() -> Column:
    return ratio(spread(), (F.col("bid_px_01") + F.col("ask_px_01")) / 2)


def microprice() -> Column:
    bid, ask = F.col("bid_sz_01"), F.col("ask_sz_01")
    return ratio(F.col("bid_px_01") * ask + F.col("ask_px_01") * bid, bid + ask)


def imbalance(k: int = 1, skip_null: bool = True) -> Column:
    """(bid - ask) / (bid + ask) of the sizes of k levels; skip_null counts a missing level as zero, else it makes NULL."""
    bid, ask = _sum(levels("bid", "sz", k), skip_null and k > 1), _sum(levels("ask", "sz", k), skip_null and k > 1)
    return ratio(bid - ask, bid + ask)


def top_volume(side: str, k: int) -> Column:
    return _sum(levels(side, "sz", k), True)


def best_distances(tick: float) -> dict[str, Column]:
    mid = F.col("mid_px")
    return {
        "mid_to_bid_ticks": (mid - F.col("bid_px_01")) / tick,
        "mid_to_ask_ticks": (F.col("ask_px_01") - mid) / tick,
        "spread_bps": relative_spread() * 1e4,
        "microprice_minus_mid_ticks": (microprice() - mid) / tick,
    }


def signed_distances(tick: float, depth: int = DEPTH) -> dict[str, Column]:
    """Both sides at or below zero: bid price less mid, mid less ask price."""
    mid = F.col("mid_px")
    out = {}
    for i in range(1, depth + 1):
        out[f"bid_dist_signed_{i:02d}"] = (F.col(level("bid", "px", i)) - mid) / tick
        out[f"ask_dist_signed_{i:02d}"] = (mid - F.col(level("ask", "px", i))) / tick
    return out


def cumulative_depth(depth: int = DEPTH) -> dict[str, Column]:
    out = {}
    for k in range(1, depth + 1):
        bid, ask = top_volume("bid", k), top_volume("ask", k)
        out |= {f"bid_cum_sz_{k:02d}": bid, f"ask_cum_sz_{k:02d}": ask, f"depth_asymmetry_{k:02d}": ratio(bid - ask, bid + ask)}
    return out


def depth_group(tick: float, depth: int = DEPTH) -> dict[str, Column]:
    """Distances at or above zero, sizes as shares, cumulated sizes and their shares; a missing level makes the sums NULL."""
    mid, out = F.col("mid_px"), {}
    for side, sign in (("bid", 1), ("ask", -1)):
        total = _sum(levels(side, "sz", depth), False)
        for i in range(1, depth + 1):
            px = F.col(level(side, "px", i))
            out[f"{side}_dist_{i:02d}"] = (mid - px if sign > 0 else px - mid) / tick
            out[f"{side}_sz_norm_{i:02d}"] = safe_divide(F.col(level(side, "sz", i)), total)
        for k in (1, 3, 5, 10):
            if k <= depth:
                own = _sum(levels(side, "sz", k), False)
                out[f"{side}_cum_{k}"] = own
                out[f"{side}_cum_ratio_{k}"] = safe_divide(own, total)
    return out


def book_shape(side: str, tick: float, depth: int = DEPTH) -> dict[str, Column]:
    """Least-squares slope of the distances on the level number and mean second difference, over the levels that are there."""
    sign = 1 if side == "bid" else -1
    dist = [(F.col("mid_px") - F.col(level(side, "px", i))) * sign / tick for i in range(1, depth + 1)]
    have = [F.when(d.isNotNull(), F.lit(1.0)).otherwise(0.0) for d in dist]
    n = reduce(add, have)
    mean_d = ratio(reduce(add, (F.coalesce(d, F.lit(0.0)) for d in dist)), n)
    mean_i = (depth + 1) / 2
    # sum of (d - mean) * c over the levels there is sum(d * c) - mean * sum(c)
    top = reduce(add, (F.coalesce(d * (i + 1 - mean_i), F.lit(0.0)) for i, d in enumerate(dist)))
    top = top - mean_d * reduce(add, (h * (i + 1 - mean_i) for i, h in enumerate(have)))
    bottom = sum((i + 1 - mean_i) ** 2 for i in range(depth))
    second = [dist[i + 2] - dist[i + 1] * 2 + dist[i] for i in range(depth - 2)]
    count = reduce(add, (F.when(s.isNotNull(), F.lit(1.0)).otherwise(0.0) for s in second))
    total = reduce(add, (F.coalesce(s, F.lit(0.0)) for s in second))
    return {f"{side}_slope": F.when(n > 0, top / F.lit(bottom)), f"{side}_convexity": ratio(total, count)}


def imbalance_signal(column: str, threshold: float = 0.2) -> Column:
    """1, -1 or 0 (also for NULL)."""
    x = F.col(column)
    return F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0)


def valid_book(depth: int = DEPTH) -> Column:
    """All sizes above zero and the best bid below the best ask."""
    sizes = (F.coalesce(F.col(c) > 0, F.lit(False)) for s in ("bid", "ask") for c in levels(s, "sz", depth))
    return reduce(lambda a, b: a & b, sizes) & F.coalesce(F.col("bid_px_01") < F.col("ask_px_01"), F.lit(False))


def with_spread(df: DataFrame) -> DataFrame:
    require(df, ["bid_px_01", "ask_px_01"])
    return df.withColumns({"spread": spread(), "relative_spread": relative_spread()})


def with_imbalance(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    require(df, [*levels("bid", "sz", depth), *levels("ask", "sz", depth)])
    return df.withColumns({"imbalance_l1": imbalance(1), f"imbalance_l{depth}": imbalance(depth)})


def with_microprice(df: DataFrame) -> DataFrame:
    require(df, ["bid_px_01", "ask_px_01", "bid_sz_01", "ask_sz_01"])
    return df.withColumn("microprice", microprice())
