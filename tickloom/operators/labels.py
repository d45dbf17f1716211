"""Forward labels: moves, profitability after fees, take-profit and stop-loss order."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..cuts import cut
from ..functions.timewin import SECOND, asof, in_row_blocks, ordered


@dataclass(frozen=True)
class Fees:
    maker: float = 0.0002
    taker: float = 0.0007
    min_profit_ticks: float = 0.0


def flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def future_move(mid: str, rows: int, threshold: float, over: WindowSpec) -> Column:
    """1, -1 or 0 by the relative change after `rows` rows against +-threshold, strictly; the tail and a zero mid give 0."""
    change = F.try_divide(F.lead(mid, rows).over(over) - F.col(mid), F.col(mid))
    return F.when(change > threshold, 1).when(change < -threshold, -1).otherwise(0)


def grid_regularity(df: DataFrame, grid_us: int, by: tuple[str, ...] = ("inst_id",), least: float = 0.999) -> DataFrame:
    """Share of gaps of exactly grid_us between distinct times, over all rows; regular false and share NULL for under two times."""
    # gaps are counted within time buckets; the gap into a bucket is that from the last time of the bucket before, one row a bucket
    times = df.select(*by, "ts_us").distinct().withColumn("__b", F.coalesce(F.floor(F.col("ts_us") / (3600 * SECOND)), F.lit(-(1 << 62))))
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*by, "__b").orderBy("ts_us"))
    own = times.withColumn("gap", gap).groupBy(*by, "__b").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"), F.count("gap").alias("n"), F.count_if(F.col("gap") == grid_us).alias("k"))
    into = F.col("a") - F.lag("z").over(Window.partitionBy(*by).orderBy("__b"))
    found = own.withColumn("into", into).groupBy(*by).agg(((F.sum("k") + F.count_if(F.col("into") == grid_us)) / F.nullif(F.sum("n") + F.count("into"), F.lit(0))).alias("share"))
    return found.withColumn("regular", F.coalesce(F.col("share") >= least, F.lit(False)))


def future_values(df: DataFrame, columns: list[str], horizon_ms: int, grid_ms: int, method: str = "auto", over: WindowSpec | None = None) -> DataFrame:
    """df with future_<c>: after ceil(horizon / grid) rows (shift), or at the first row at or after ts + horizon (nearest_forward, with
    exact_match). auto takes shift for instruments whose times lie on the grid, nearest_forward for the others.
    over: the window of shift, if df is dealt in blocks of rows."""
    k = max(1, ceil(horizon_ms / grid_ms))
    if method == "shift":
        return df.select("*", *(F.lead(c, k).over(over or ordered()).alias(f"future_{c}") for c in columns))
    if method == "auto":
        on, off = _by_grid(df, grid_ms * 1000)
        shifted = in_row_blocks(on, lambda rows, w: future_values(rows, columns, horizon_ms, grid_ms, "shift", w), after=k)
        shifted = shifted.withColumn("exact_match", F.when(F.col(f"future_{columns[0]}").isNotNull(), True))
        return shifted.unionByName(future_values(off, columns, horizon_ms, grid_ms, "nearest_forward"))
    if method != "nearest_forward":
        raise ValueError(f"unknown alignment {method!r}")
    value = F.struct(*(F.col(c) for c in columns), "ts_us")
    found = asof(df, df, F.col("ts_us") + horizon_ms * 1000, F.col("ts_us"), value, "forward", out="__f")
    return found.select("*", *(F.col(f"__f.{c}").alias(f"future_{c}") for c in columns), (F.col("__f.ts_us") == F.col("ts_us") + horizon_ms * 1000).alias("exact_match")).drop("__f")


def _by_grid(df: DataFrame, grid_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the instruments whose times lie on the grid, and the others."""
    flags = cut(grid_regularity(df, grid_us).select(F.col("inst_id").alias("__i"), "regular"), "grid")
    rows = df.join(F.broadcast(flags), F.col("inst_id").eqNullSafe(F.col("__i")), "left").drop("__i")
    return rows.where("regular").drop("regular"), rows.where("regular is null or not regular").drop("regular")


def tick_direction_targets(df: DataFrame, tick: float, grid_ms: int, horizons_ms: tuple[int, ...] = (500, 1000, 3000, 5000, 10000), steps: tuple[int, ...] = (1, 2, 3), method: str = "auto") -> DataFrame:
    """df with, for each horizon h: mid_move_ticks_h<h>, best_bid_ and best_ask_move_ticks_h<h>, target_mid_dir_h<h> (beyond half a tick),
    target_mid_ge_<n>tick_h<h>, target_mid_le_minus_<n>tick_h<h> and exact_h<h> (alignment). Moves are NULL in the tail, labels 0.
    auto: rows of instruments on the grid are shifted in blocks, those of the others looked up; they part once, whatever the number of horizons."""
    if method == "auto":
        on, off = _by_grid(df, grid_ms * 1000)
        ahead = max((max(1, ceil(h / grid_ms)) for h in horizons_ms), default=0)
        shifted = in_row_blocks(on, lambda rows, w: _tick_targets(rows, tick, grid_ms, horizons_ms, steps, "shift", w), after=ahead)
        shifted = shifted.withColumns({f"exact_h{h}": F.when(F.col(f"exact_h{h}"), True) for h in horizons_ms})
        return shifted.unionByName(_tick_targets(off, tick, grid_ms, horizons_ms, steps, "nearest_forward"))
    return _tick_targets(df, tick, grid_ms, horizons_ms, steps, method)


def _tick_targets(df: DataFrame, tick: float, grid_ms: int, horizons_ms: tuple[int, ...], steps: tuple[int, ...], method: str, over: WindowSpec | None = None) -> DataFrame:
    names = list(df.columns)
    for h in horizons_ms:
        df = future_values(df, ["mid_px", "bid_px_01", "ask_px_01"], h, grid_ms, method, over)
        move = lambda c: (F.col(f"future_{c}") - F.col(c)) / tick
        mid = move("mid_px")
        out = {f"mid_move_ticks_h{h}": mid, f"best_bid_move_ticks_h{h}": move("bid_px_01"), f"best_ask_move_ticks_h{h}": move("ask_px_01")}
        out[f"target_mid_dir_h{h}"] = F.when(mid > 0.5, 1).when(mid < -0.5, -1).otherwise(0)
        for n in steps:
            out |= {f"target_mid_ge_{n}tick_h{h}": flag(mid >= n), f"target_mid_le_minus_{n}tick_h{h}": flag(mid <= -n)}
        out[f"exact_h{h}"] = F.col("exact_match") if "exact_match" in df.columns else mid.isNotNull()
        names += out
        df = df.withColumns(out).select(*names)
    return df


def alignment_report(df: DataFrame, horizons_ms: tuple[int, ...], grid_ms: int) -> DataFrame:
    """(horizon_ms, steps, aligned_ms, inexact) of a table of tick_direction_targets: how many future rows are not exactly at the horizon."""
    items = F.array(*(F.struct(F.lit(h).alias("horizon_ms"), F.lit(ceil(h / grid_ms)).alias("steps"), (F.col(f"mid_move_ticks_h{h}").isNotNull() & ~F.coalesce(F.col(f"exact_h{h}"), F.lit(True))).alias("off")) for h in horizons_ms))
    rows = df.select(F.explode(items).alias("i")).groupBy("i.horizon_ms", "i.steps").agg(F.count_if("i.off").alias("inexact"))
    return rows.withColumn("aligned_ms", F.col("steps") * grid_ms)


def direction_targets(name: str, now: str, future: str, tick: float, steps: tuple[int, ...] = (1, 2, 3)) -> dict[str, Column]:
    move = (F.col(future) - F.col(now)) / tick
    out = {f"{name}_move_ticks": move, f"{name}_dir": F.when(move > 0.5, 1).when(move < -0.5, -1).otherwise(0)}
    for n in steps:
        out |= {f"{name}_up_{n}t": flag(move >= n), f"{name}_down_{n}t": flag(move <= -n)}
    return out


def profit_targets(tick: float, min_ticks: float = 1.0, fees: Fees = Fees()) -> dict[str, Column]:
    """From bid_px_01, ask_px_01 and their future_ twins: gross and net profitability of a long and a short, and of either."""
    bid, ask, fbid, fask = (F.col(c) for c in ("bid_px_01", "ask_px_01", "future_bid_px_01", "future_ask_px_01"))
    out = {}
    for side, entry, leave, gross in (("long", bid, fask, (fask - bid) / tick), ("short", ask, fbid, (ask - fbid) / tick)):
        cost = (entry * fees.maker + leave * fees.taker) / tick
        out |= {f"gross_profitable_{side}": flag(gross >= min_ticks), f"net_profitable_{side}": flag(gross - cost - fees.min_profit_ticks >= 0)}
    for kind in ("gross", "net"):
        out[f"{kind}_profitable_any"] = F.greatest(out[f"{kind}_profitable_long"], out[f"{kind}_profitable_short"])
    return out


def tp_sl_label(side: str, tick: float, take: float, stop: float, steps: int, over: WindowSpec) -> Column:
    """1 if the mid first gains `take` ticks on the entry (long: best bid, short: best ask) within `steps` rows, -1 if it first loses
    `stop` or both fall on one row, else 0. The tail's windows are shorter. One list a row, of the frame's mids, so the plan does not
    grow with `steps`."""
    entry = F.col("bid_px_01" if side == "long" else "ask_px_01")
    path = F.collect_list(F.struct("mid_px")).over(over.rowsBetween(1, steps))
    gain = (lambda m: (m["mid_px"] - entry) / tick) if side == "long" else (lambda m: (entry - m["mid_px"]) / tick)
    first = lambda test: F.array_position(F.transform(path, lambda m: F.coalesce(test(gain(m)), F.lit(False))), True)
    tp, sl = first(lambda g: g >= take), first(lambda g: g <= -stop)
    return F.when((tp > 0) & ((sl == 0) | (tp < sl)), 1).when(sl > 0, -1).otherwise(0)


def seconds(ms: int) -> int:
    return ms * SECOND // 1000
