"""Builders: baseline (row-count) features, wall-clock features, modeling datasets. All windows of a builder share one ordering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..cuts import cut
from ..functions import rowwise as R
from ..functions.bins import tercile_buckets
from ..functions.roles import declare
from ..functions.timewin import SECOND, carried_last, full_frame, in_row_blocks, ordered, past_starts, prefix_sums, time_bucket
from ..schema import DEPTH, levels, ratio, safe_divide
from .labels import Fees, direction_targets, future_values, profit_targets
from .passage import entry_exits


def baseline_features(df: DataFrame, tick: float, grid_ms: int, lookbacks_ms: Sequence[int] = (100, 500, 1000, 5000), depth: int = DEPTH) -> DataFrame:
    """Row-wise features, then lags, ranges, volatility and mid changes over ceil(lookback / grid) rows of an instrument, dealt in blocks."""
    return in_row_blocks(df, lambda rows, w: _baseline(rows, w, tick, grid_ms, lookbacks_ms, depth), before=_rows_back(grid_ms, lookbacks_ms))


def _rows_back(grid_ms: int, lookbacks_ms: Sequence[int]) -> int:
    """Rows before its own that a feature sees: the longest look-back and the step into its first row."""
    return max((ceil(ms / grid_ms) for ms in lookbacks_ms), default=0) + 1


def _baseline(df: DataFrame, w: WindowSpec, tick: float, grid_ms: int, lookbacks_ms: Sequence[int], depth: int = DEPTH) -> DataFrame:
    first = {"spread": R.spread(), "relative_spread": R.relative_spread(), "microprice": R.microprice()}
    first |= {f"imbalance_top{k}": R.imbalance(k) for k in (1, 3, 5, depth)} | {f"{s}_volume_top{k}": R.top_volume(s, k) for s in ("bid", "ask") for k in (1, 3, 5, depth)}
    first |= R.best_distances(tick) | R.signed_distances(tick, depth) | R.cumulative_depth(depth)
    rows = df.withColumns(first)
    mid, back = F.col("mid_px"), F.lag("mid_px").over(w)
    rows = rows.withColumns({"__ret": ratio(mid - back, back), "__changed": F.coalesce(mid != back, F.lit(True)).cast("int")})
    out = {}
    for ms in lookbacks_ms:
        k, h = ceil(ms / grid_ms), f"h{ms}"
        lag = F.lag("mid_px", k).over(w)
        out[f"mid_return_{h}"] = ratio(mid - lag, lag)
        for name in ("spread", "imbalance_top1", f"imbalance_top{depth}", "bid_sz_01", "ask_sz_01"):
            out[f"{name}_change_{h}"] = F.col(name) - F.lag(name, k).over(w)
        out[f"spread_ticks_change_{h}"] = out[f"spread_change_{h}"] / tick
        out[f"mid_vol_{h}"] = full_frame(F.stddev_samp("__ret"), w, k, F.col("__ret"))
        out[f"mid_range_ticks_{h}"] = full_frame(F.max("mid_px"), w, k) / tick - full_frame(F.min("mid_px"), w, k) / tick
        out[f"mid_changes_{h}"] = full_frame(F.sum("__changed"), w, k)
    return rows.withColumns(out).drop("__ret", "__changed")


def step_flows(df: DataFrame, depth: int = DEPTH, over: WindowSpec | None = None) -> DataFrame:
    """Per row, sizes added and removed since the last row, summed over the levels of a side (by rank); zero on the first row."""
    w, out = over or ordered(), {}
    for side in ("bid", "ask"):
        change = [F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in levels(side, "sz", depth)]
        zero = F.lit(0.0)
        out[f"{side}_added"] = sum((F.greatest(d, zero) for d in change), zero)
        out[f"{side}_removed"] = sum((F.greatest(-d, zero) for d in change), zero)
    return df.withColumns(out)


def wallclock_features(df: DataFrame, tick: float, windows_s: Sequence[int] = (1, 3, 5, 10, 30), depth: int = DEPTH, large_move_ticks: float = 20.0, keep_book: bool = False) -> DataFrame:
    """Price, depth, imbalance, order-flow and regime groups; only rows at or before a row's time enter its features, but for the
    regime edges, which are full-sample quantiles of each instrument.

    A window's start is the first row at or after ts - w, found for all windows by one as-of union of slim rows; sums over a window
    are differences of prefix sums, so cost does not depend on its length. What a row knows of its predecessor is made in blocks
    of numbered rows and written once, what it knows of itself when it is read again, so columns that nobody asks for are never made, slim rows with running sums and the window features once each: later steps read the columns they need
    of these, and df is read three times (time span, numbers, rows), however many windows there are. No task sorts an instrument.
    """
    book = [c for c in df.columns if c.startswith(("bid_px_", "bid_sz_", "ask_px_", "ask_sz_"))]
    depths = (1, 3, 5, depth)
    summed = ("step", "step_sq", "bid_added", "bid_removed", "ask_added", "ask_removed")

    def of_row(rows: DataFrame, w: WindowSpec) -> DataFrame:
        step = F.coalesce((F.col("mid_px") - F.lag("mid_px").over(w)) / tick, F.lit(0.0))
        return step_flows(rows.withColumn("step", step), depth, w).withColumn("step_sq", F.col("step") * F.col("step"))

    bucket = time_bucket(df)
    base = cut(in_row_blocks(df, of_row, before=1, rn="rn", bucket=bucket), "wallclock")
    own = {f"imbalance_{k}": R.imbalance(k, skip_null=False) for k in depths} | R.depth_group(tick, depth) | R.book_shape("bid", tick, depth) | R.book_shape("ask", tick, depth)
    own |= {"spread_ticks": F.col("spread_px") / tick, "spread_over_mid": safe_divide(F.col("spread_px"), F.col("mid_px"))}
    base = base.withColumns(own).select(*df.columns, *own, *summed, "rn")
    imbalances = [f"imbalance_{k}" for k in depths]
    slim = base.select("inst_id", "event_id", "ts_us", "rn", "mid_px", "spread_ticks", *imbalances, *summed)
    keyed = cut(prefix_sums(slim, summed, bucket=bucket), "sums")
    names = ("ts_us", "rn", "mid_px", *imbalances, *(f"cum_{c}" for c in summed), *summed)
    starts = past_starts(keyed.select("inst_id", "event_id", *names), windows_s, F.struct(*names)).withColumnsRenamed({"inst_id": "__i", "rn": "__rn"})
    met = keyed.join(starts, F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col("rn") == F.col("__rn")), "left")
    found: dict[str, Column] = {}
    for s in windows_s:
        start = lambda c, s=s: F.col(f"s_{s}.{c}")
        elapsed = (F.col("ts_us") - start("ts_us")) / SECOND
        move = (F.col("mid_px") - start("mid_px")) / tick
        n = (F.col("rn") - start("rn")).cast("double")
        sx, sq = F.col("cum_step") - start("cum_step"), F.col("cum_step_sq") - start("cum_step_sq")
        flow = {c: F.col(f"cum_{c}") - start(f"cum_{c}") + start(c) for c in summed[2:]}  # the step into the start counts
        bid, ask = flow["bid_added"] - flow["bid_removed"], flow["ask_added"] - flow["ask_removed"]
        found |= {f"mid_return_{s}s": move, f"mid_velocity_{s}s": safe_divide(move, elapsed)}
        found |= {f"realized_vol_{s}s": F.when(n >= 2, F.sqrt(F.greatest((sq - sx * sx / n) / (n - 1), F.lit(0.0))))}
        found |= {f"{c}_delta_{s}s": F.col(c) - start(c) for c in imbalances} | {f"{c}_{s}s": x for c, x in flow.items()}
        found |= {f"bid_net_flow_{s}s": bid, f"ask_net_flow_{s}s": ask, f"order_flow_imbalance_{s}s": ratio(bid - ask, F.abs(bid) + F.abs(ask))}
        found |= {f"update_intensity_{s}s": F.col("rn") - start("rn") + 1}
    first = F.col("s_1.rn") if 1 in windows_s else F.lit(None).cast("bigint")
    rows = cut(met.select("inst_id", "event_id", "ts_us", "rn", "spread_ticks", first.alias("__start"), *(c.alias(n) for n, c in found.items())), "windows")
    more = []
    if 1 in windows_s:
        before = rows.select(F.col("inst_id").alias("__i"), F.col("rn").alias("__rn"), F.struct("mid_velocity_1s", "imbalance_5_delta_1s", "ts_us").alias("__s"))
        rows = rows.join(before, F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col("__start") == F.col("__rn")), "left").drop("__i", "__rn")
        elapsed = (F.col("ts_us") - F.col("__s.ts_us")) / SECOND
        pairs = (("mid_acceleration_1s", "mid_velocity_1s"), ("imbalance_5_acceleration_1s", "imbalance_5_delta_1s"))
        rows = rows.withColumns({n: safe_divide(F.col(c) - F.col(f"__s.{c}"), elapsed) for n, c in pairs}).drop("__s")
        more = [n for n, _ in pairs]
    vol = f"realized_vol_{30 if 30 in windows_s else max(windows_s)}s"
    intensity = f"update_intensity_{5 if 5 in windows_s else min([w for w in windows_s if w >= 5] or windows_s)}s"
    regimes = {vol: "volatility_regime", "spread_ticks": "spread_regime", intensity: "activity_regime"}
    moved = F.when(F.abs(F.col(f"mid_return_{1 if 1 in windows_s else min(windows_s)}s")) > large_move_ticks, F.col("ts_us"))
    rows = tercile_buckets(rows, regimes, by=("inst_id",)).withColumn("__moved", moved)
    rows = carried_last(rows, rows, "__moved", "ts_us", ("event_id",), [F.asc("ts_us"), F.asc("event_id")], "__last", bucket=bucket)
    since = ((F.col("ts_us") - F.col("__last")) / SECOND).alias("seconds_since_large_move")
    made = [*found, *more, *regimes.values()]
    rows = rows.select(F.col("inst_id").alias("__i"), F.col("rn").alias("__rn"), *made, since)
    whole = base.join(rows, F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col("rn") == F.col("__rn")))
    kept = [c for c in base.columns if c not in ("rn", "step", "step_sq") and (keep_book or c not in book)]
    return declare(whole.select(*kept, *made, "seconds_since_large_move"), df.columns)


@dataclass(frozen=True)
class ModelingConfig:
    tick: float = 0.1
    grid_ms: int = 100
    horizons_ms: tuple[int, ...] = (100, 150, 200, 250, 500, 1000)
    method: str = "shift"
    take_profit_ticks: tuple[int, ...] = (1, 2, 3)
    stop_loss_ticks: tuple[int, ...] = (1, 2)
    holding_ms: tuple[int, ...] = (100, 250, 500, 1000)
    fees: Fees = field(default_factory=Fees)
    lookbacks_ms: tuple[int, ...] = (100, 200, 500, 1000)


def modeling_dataset(df: DataFrame, config: ModelingConfig = ModelingConfig()) -> DataFrame:
    """Baseline features, direction and profit targets of each horizon and take-profit / stop-loss labels; rows whose moves are not all
    known are dropped. Columns are added in one plan, never joined by position. With shift, features and moves are one pass over blocks of
    rows; the labels of all exits are one entry_passage over slim rows. Every column says what it is (functions/roles.py)."""
    back, ahead = _rows_back(config.grid_ms, config.lookbacks_ms), max((ceil(ms / config.grid_ms) for ms in config.horizons_ms), default=0)
    names = [f"{price}_h{ms}_move_ticks" for ms in config.horizons_ms for price in ("mid", "bid", "ask")]
    rows = entry_exits(df, config.tick, config.take_profit_ticks, config.stop_loss_ticks, {f"h{ms}": ceil(ms / config.grid_ms) for ms in config.holding_ms})
    if config.method == "shift":
        both = lambda rows, w: _moves(_baseline(rows, w, config.tick, config.grid_ms, config.lookbacks_ms), config, w)
        rows = in_row_blocks(rows, both, back, ahead)
    else:
        rows = _moves(baseline_features(rows, config.tick, config.grid_ms, config.lookbacks_ms), config)
    return declare(rows.dropna(subset=names), df.columns)


def _moves(rows: DataFrame, config: ModelingConfig, over: WindowSpec | None = None) -> DataFrame:
    """Direction and profit targets of each horizon."""
    for ms in config.horizons_ms:
        rows = future_values(rows, ["mid_px", "bid_px_01", "ask_px_01"], ms, config.grid_ms, config.method, over)
        targets = {}
        for name, column in (("mid", "mid_px"), ("bid", "bid_px_01"), ("ask", "ask_px_01")):
            targets |= direction_targets(f"{name}_h{ms}", column, f"future_{column}", config.tick)
        targets |= {f"{k}_h{ms}": v for k, v in profit_targets(config.tick, fees=config.fees).items()}
        rows = rows.withColumns(targets).drop("future_mid_px", "future_bid_px_01", "future_ask_px_01", "exact_match")
    return rows


def metadata(df: DataFrame, config: ModelingConfig) -> dict:
    """Row count, time range and column families of a modeling dataset (one aggregation)."""
    r = df.agg(F.count("*").alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("z")).first()
    family = lambda p: [c for c in df.columns if c.startswith(p)]
    return {"rows": r["n"], "first_us": r["a"], "last_us": r["z"], "tick": config.tick, "alignment": config.method, "targets": {k: len(family(k)) for k in ("mid_h", "bid_h", "ask_h", "gross_", "net_", "tp_sl_")}}
