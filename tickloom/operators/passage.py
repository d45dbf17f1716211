"""Excursions and first passage within wall-clock horizons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import with_quantiles
from ..functions.roles import declare
from ..functions.timewin import BY, SECOND, numbered


def excursions(df: DataFrame, horizon_s: int, tick: float, mid: str = "mid_px", by: Sequence[str] = ("inst_id",), key: str = "event_id", bucket_s: int | None = None) -> DataFrame:
    """df with mfe_long, mae_long (greatest gain and loss in ticks over the rows in (t, t + H], at least 0; a short's are swapped)
    and complete (t + H is not after the last row). `key` tells rows of one instrument apart.

    Rows are dealt by time buckets with a halo of one horizon, and a frame's extremes are read off two overlapping blocks of a
    doubling table, so neither an instrument nor a long horizon is one task's or one row's work.
    """
    step, reach = (bucket_s or max(4 * horizon_s, 86400)) * SECOND, horizon_s * SECOND
    own = F.floor(F.col("ts_us") / step)
    rows = df.select(*by, F.col(key).alias("__key"), "ts_us", F.col(mid).cast("double").alias("__mid"), own.alias("__own"))
    rows = rows.withColumn("__b", F.explode(F.sequence(F.floor((F.col("ts_us") - reach) / step), own)))
    names = [f"__by{i}" for i in range(len(by))]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_us", kind="stable")
        ts, x = pdf["ts_us"].to_numpy(), pdf["__mid"].to_numpy(float)
        anchors = np.flatnonzero((pdf["__own"] == pdf["__b"]).to_numpy())
        out = pdf.iloc[anchors][[*by, "__key"]].set_axis([*names, "__k"], axis=1)
        begin, end = np.searchsorted(ts, ts[anchors], "right"), np.searchsorted(ts, ts[anchors] + reach, "right")
        size = end - begin
        level = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, 0)
        for name, sign in (("__hi", 1.0), ("__lo", -1.0)):
            best, last = np.full(len(anchors), np.nan), sign * x
            for j in range(int(level.max(initial=0)) + 1):
                at = np.flatnonzero((level == j) & (size > 0))
                best[at] = np.fmax(last[begin[at]], last[end[at] - (1 << j)])
                w = 1 << j
                last = np.fmax(last, np.r_[last[w:], np.full(min(w, len(x)), np.nan)][: len(x)])
            out[name] = sign * best
        return out

    parts = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, by, strict=True))
    found = rows.groupBy(*by, "__b").applyInPandas(scan, f"{parts}, __k {df.schema[key].dataType.simpleString()}, __hi double, __lo double")
    ends = df.groupBy(*(F.col(c).alias(f"__end{i}") for i, c in enumerate(by))).agg(F.max("ts_us").alias("__last"))
    joined = df.join(found, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)] + [F.col(key) == F.col("__k")], "left")
    joined = joined.join(ends, [F.col(c).eqNullSafe(F.col(f"__end{i}")) for i, c in enumerate(by)], "left")
    x, zero, whole = F.col(mid), F.lit(0.0), lambda c: F.when(~F.isnan(c), F.col(c))
    ticks = lambda d: F.greatest(F.coalesce(d / tick, zero), zero)
    return joined.select(*(F.col(c) for c in df.columns), ticks(whole("__hi") - x).alias("mfe_long"), ticks(x - whole("__lo")).alias("mae_long"), (F.col("ts_us") + reach <= F.col("__last")).alias("complete"))


def first_passage(df: DataFrame, horizon_s: int, tick: float, ticks: Sequence[float], mid: str = "mid_px", key: str = "event_id", by: Sequence[str] = ("inst_id",), bucket_s: int | None = None) -> DataFrame:
    """(by, key, up_<k>, down_<k>): the time in microseconds from a row to the first later row within the horizon whose mid is at
    least k ticks above, or below; NULL if there is none.

    Rows are dealt by time buckets with a halo of one horizon, so a task scans a bounded stretch of one instrument. In it, the
    first row to reach a level is found for all anchors at once by doubling jumps over block maxima (and minima).
    """
    step = (bucket_s or max(4 * horizon_s, 86400)) * SECOND
    reach = horizon_s * SECOND
    kind = df.schema[key].dataType.simpleString()
    columns = ", ".join(f"up_{k:g} bigint, down_{k:g} bigint" for k in ticks)
    own = F.floor(F.col("ts_us") / step)
    rows = df.select(*by, F.col(key).alias("__key"), "ts_us", F.col(mid).cast("double").alias("__mid"), own.alias("__own"))
    rows = rows.withColumn("__b", F.explode(F.sequence(F.floor((F.col("ts_us") - reach) / step), own)))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_us", "__key"], kind="stable")
        ts, x = pdf["ts_us"].to_numpy(), pdf["__mid"].to_numpy()
        n = len(x)
        anchors = np.flatnonzero((pdf["__own"] == pdf["__b"]).to_numpy())
        out = pdf.iloc[anchors][[*by, "__key"]].rename(columns={"__key": key})
        ends = np.searchsorted(ts, ts[anchors] + reach, "right")
        for sign, name in ((1.0, "up"), (-1.0, "down")):
            tops = [x * sign]
            while 1 << len(tops) <= n:  # tops[j][i]: the greatest of 2^j rows from i on
                w = 1 << (len(tops) - 1)
                last = tops[-1]
                tops.append(np.fmax(last, np.r_[last[w:], np.full(min(w, n), -np.inf)][:n]))
            for k in ticks:
                at = anchors + 1
                reached = lambda top, here: sign * (sign * top - x[anchors]) / tick >= k  # noqa: E731, B023
                for j in range(len(tops) - 1, -1, -1):
                    inside = at + (1 << j) <= ends
                    at = np.where(inside & ~reached(tops[j][np.minimum(at, n - 1)], at), at + (1 << j), at)
                hit = (at < ends) & reached(tops[0][np.minimum(at, n - 1)], at)
                wait = pd.array(ts[np.minimum(at, n - 1)] - ts[anchors], dtype="Int64")
                wait[~hit] = pd.NA
                out[f"{name}_{k:g}"] = wait
        return out[[*by, key, *(f"{s}_{k:g}" for k in ticks for s in ("up", "down"))]]

    parts = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by, "__b").applyInPandas(scan, f"{parts}, {key} {kind}, {columns}")


def entry_passage(
    df: DataFrame, steps: int, tick: float, sides: dict[str, str], takes: Sequence[float], stops: Sequence[float], mid: str = "mid_px", key: str = "event_id",
    by: Sequence[str] = BY, block: int = 1 << 16,
) -> DataFrame:
    """(by, key, <side>_take_<k>, <side>_stop_<k>): how many rows on the mid first gains (loses) k ticks on the row's own entry price, within
    `steps` rows; NULL if it does not. sides: the column of the entry price of `long` and of `short`.

    Rows are numbered by time buckets and dealt in blocks with a halo of `steps`; a task finds all rows' first hits by doubling jumps over the
    extremes of the mid, whose levels come from another column, so no row holds a list and time grows with the logarithm of steps.
    """
    block = max(block, 2 * steps)
    kind = lambda c: df.schema[c].dataType.simpleString()
    slim = df.select(*by, "ts_us", key, F.col(mid).cast("double").alias("__mid"), *(F.col(c).cast("double").alias(f"__{side}") for side, c in sides.items()))
    rows = numbered(slim, by, ("ts_us", key), "__rn")
    own = F.floor((F.col("__rn") - 1) / block)
    rows = rows.withColumn("__own", own).withColumn("__b", F.explode(F.sequence(F.floor((F.col("__rn") - 1 - steps) / block), own))).where("__b >= 0")
    wanted = [(side, what, k) for side in sides for what, ks in (("take", takes), ("stop", stops)) for k in ks]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn", kind="stable")
        x, n = pdf["__mid"].to_numpy(), len(pdf)
        anchors = np.flatnonzero((pdf["__own"] == pdf["__b"]).to_numpy())
        out = pdf.iloc[anchors][[*by, key]]
        ends = np.minimum(anchors + 1 + steps, n)
        extremes = {}
        for sign in (1.0, -1.0):
            tops = [x * sign]
            while 1 << len(tops) <= min(n, steps):  # tops[j][i]: the greatest of 2^j rows from i on
                w, last = 1 << (len(tops) - 1), tops[-1]
                tops.append(np.fmax(last, np.r_[last[w:], np.full(min(w, n), -np.inf)][:n]))
            extremes[sign] = tops
        for side, what, k in wanted:
            entry = pdf[f"__{side}"].to_numpy()[anchors]
            sign = 1.0 if (side == "long") == (what == "take") else -1.0
            tops, at = extremes[sign], anchors + 1
            with np.errstate(invalid="ignore"):
                reached = lambda top: (top - sign * entry) / tick >= k  # noqa: E731, B023
                for j in range(len(tops) - 1, -1, -1):
                    inside = at + (1 << j) <= ends
                    at = np.where(inside & ~reached(tops[j][np.minimum(at, n - 1)]), at + (1 << j), at)
                hit = (at < ends) & reached(tops[0][np.minimum(at, n - 1)])
            rows_on = pd.array(at - anchors, dtype="Int32")
            rows_on[~hit] = pd.NA
            out[f"{side}_{what}_{k:g}"] = rows_on
        return out

    parts = ", ".join(f"`{c}` {kind(c)}" for c in (*by, key))
    return rows.groupBy(*by, "__b").applyInPandas(scan, ", ".join([parts, *(f"{side}_{what}_{k:g} int" for side, what, k in wanted)]))


def entry_exits(
    df: DataFrame, tick: float, takes: Sequence[float], stops: Sequence[float], holds: dict[str, int], mid: str = "mid_px", key: str = "event_id", by: Sequence[str] = BY
) -> DataFrame:
    """df with tp_sl_<side>_tp<take>_sl<stop>_<name> for each holding time (name: rows): 1 if the mid first gains `take` ticks on the entry (long: the
    best bid, short: the best ask) within so many rows, -1 if it first loses `stop` or both fall on one row, else 0. All labels come from one
    entry_passage of the longest holding time. (by, key) must be unique."""
    if not (takes and stops and holds):
        return df
    passed = entry_passage(df, max(holds.values()), tick, {"long": "bid_px_01", "short": "ask_px_01"}, takes, stops, mid, key, by)
    names = {c: f"__k{i}" for i, c in enumerate((*by, key))}
    for c, n in names.items():
        passed = passed.withColumnRenamed(c, n)
    joined = df.join(passed, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left")
    within = lambda c, rows: F.when(F.col(c) <= rows, F.col(c))
    out = {}
    for name, rows in holds.items():
        for side in ("long", "short"):
            for a in takes:
                for b in stops:
                    tp, sl = within(f"{side}_take_{a:g}", rows), within(f"{side}_stop_{b:g}", rows)
                    out[f"tp_sl_{side}_tp{a}_sl{b}_{name}"] = F.when(tp.isNotNull() & (sl.isNull() | (tp < sl)), 1).when(sl.isNotNull(), -1).otherwise(0)
    return joined.select(*df.columns, *(v.alias(k) for k, v in out.items()))


def first_wins(target: str, adverse: str):
    """1 if `target` is reached and `adverse` is not, or later; else 0 (also if both are reached at one row)."""
    t, a = F.col(target), F.col(adverse)
    return F.coalesce(t.isNotNull() & (a.isNull() | (t < a)), F.lit(False)).cast("int")


def passage_targets(df: DataFrame, horizon_s: int, tick: float, thresholds: Sequence[int], adverse: Sequence[int], key: str = "event_id", drop_incomplete: bool = True) -> DataFrame:
    """Excursions, hits, symmetric and paired first-hit targets of one horizon, long and short; rows without a whole horizon go or
    keep NULL targets."""
    levels = sorted({*thresholds, *adverse})
    passed = first_passage(df, horizon_s, tick, levels, key=key).withColumnRenamed(key, "__k2").withColumnRenamed("inst_id", "__i2")
    found = excursions(df, horizon_s, tick, key=key)
    found = found.join(passed, (found["inst_id"] == passed["__i2"]) & (found[key] == passed["__k2"])).drop("__i2", "__k2")
    h = f"within_{horizon_s}s"
    out = {
        f"long_max_favorable_excursion_ticks_{h}": F.col("mfe_long"), f"long_max_adverse_excursion_ticks_{h}": F.col("mae_long"),
        f"short_max_favorable_excursion_ticks_{h}": F.col("mae_long"), f"short_max_adverse_excursion_ticks_{h}": F.col("mfe_long"),
    }
    for k in thresholds:
        out[f"long_hit_up_{k}t_{h}"] = (F.col("mfe_long") >= k).cast("int")
        out[f"short_hit_down_{k}t_{h}"] = (F.col("mae_long") >= k).cast("int")
        out[f"long_hit_up_{k}t_before_down_{h}"] = first_wins(f"up_{k}", f"down_{k}")
        out[f"short_hit_down_{k}t_before_up_{h}"] = first_wins(f"down_{k}", f"up_{k}")
    for k, a in zip(thresholds, adverse, strict=False):
        out[f"long_hit_up_{k}t_before_down_{a}t_{h}"] = first_wins(f"up_{k}", f"down_{a}")
        out[f"short_hit_down_{k}t_before_up_{a}t_{h}"] = first_wins(f"down_{k}", f"up_{a}")
    if drop_incomplete:
        found = found.where("complete")
    return found.select(*df.columns, *(F.when(F.col("complete"), c).cast("float").alias(n) for n, c in out.items()))


def targets_dataset(
    df: DataFrame, tick: float, horizons_s: Sequence[int], thresholds: Sequence[int], pairs: Sequence[tuple[int, int]] = (),
    step_rows: int = 1, drop_incomplete: bool = True, key: str = "event_id",
) -> DataFrame:
    """Excursions, hits, symmetric and paired (target, adverse) first-hit targets of every horizon at each instrument's rows 0, step,
    2 step, ...; a row whose window is not whole for any horizon goes, or keeps NULL in that horizon's targets.

    First passages are found once, for the longest horizon: a shorter one's hits are those that come in time.
    """
    for name, values in (("tick", [tick]), ("horizons_s", horizons_s), ("thresholds", thresholds), ("step_rows", [step_rows]), ("pairs", [x for p in pairs for x in p] or [1])):
        if not values or any(not x > 0 for x in values):
            raise ValueError(f"{name} must be positive and not empty: {values!r}")
    over = Window.partitionBy("inst_id").orderBy("ts_us", key)
    anchors = df.withColumn("__n", F.row_number().over(over) - 1)
    passed = first_passage(df, max(horizons_s), tick, sorted({*thresholds, *(x for p in pairs for x in p)}), key=key)
    waits = [c for c in passed.columns if c not in ("inst_id", key)]
    rows = anchors.join(passed.select(F.col("inst_id").alias("__i"), F.col(key).alias("__k"), *waits), F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col(key) == F.col("__k"))).drop("__i", "__k")
    out, whole = {}, []
    for h in horizons_s:
        rows = excursions(rows, h, tick, key=key).withColumnsRenamed({c: f"__{c}_{h}" for c in ("mfe_long", "mae_long", "complete")})
        mfe, mae, fits, w = F.col(f"__mfe_long_{h}"), F.col(f"__mae_long_{h}"), F.col(f"__complete_{h}"), f"within_{h}s"
        in_time = lambda c, h=h: F.when(F.col(c) <= h * SECOND, F.col(c))
        first = lambda a, b: F.coalesce(in_time(a).isNotNull() & (in_time(b).isNull() | (F.col(a) < F.col(b))), F.lit(False))
        found = {f"long_max_favorable_excursion_ticks_{w}": mfe, f"long_max_adverse_excursion_ticks_{w}": mae, f"short_max_favorable_excursion_ticks_{w}": mae, f"short_max_adverse_excursion_ticks_{w}": mfe}
        for k in thresholds:
            found |= {f"long_hit_up_{k}t_{w}": in_time(f"up_{k}").isNotNull(), f"short_hit_down_{k}t_{w}": in_time(f"down_{k}").isNotNull()}
            found |= {f"long_hit_up_{k}t_before_down_{w}": first(f"up_{k}", f"down_{k}"), f"short_hit_down_{k}t_before_up_{w}": first(f"down_{k}", f"up_{k}")}
        for k, a in pairs:
            found |= {f"long_hit_up_{k}t_before_down_{a}t_{w}": first(f"up_{k}", f"down_{a}"), f"short_hit_down_{k}t_before_up_{a}t_{w}": first(f"down_{k}", f"up_{a}")}
        out |= {n: F.when(fits, c.cast("float")) for n, c in found.items()}
        whole.append(fits)
    rows = rows.where(F.col("__n") % step_rows == 0)
    if drop_incomplete:
        for fits in whole:
            rows = rows.where(fits)
    return declare(rows.select(*df.columns, *(c.alias(n) for n, c in out.items())), df.columns)


def half_pairs(thresholds: Sequence[int], shares: Sequence[float] = (0.5, 0.75)) -> list[tuple[int, int]]:
    """(target, adverse) pairs whose adverse move is each share of the target, rounded down."""
    return [(k, int(s * k)) for s in shares for k in thresholds]


def tp_sl_times(df: DataFrame, take: int, stop: int, horizon_s: int, tick: float, key: str = "event_id") -> DataFrame:
    """(inst_id, key, outcome, t_tp_s, t_sl_s, target, stop, timeout): 1 if the mid gains `take` ticks before it loses `stop`, -1 if not before,
    0 if neither is reached in time; the seconds to both; the outcome as three flags."""
    passed = first_passage(df, horizon_s, tick, sorted({take, stop}), key=key)
    tp, sl = F.col(f"up_{take}"), F.col(f"down_{stop}")
    outcome = F.when(tp.isNotNull() & (sl.isNull() | (tp < sl)), 1).when(sl.isNotNull(), -1).otherwise(0)
    rows = passed.select("inst_id", key, outcome.alias("outcome"), (tp / SECOND).alias("t_tp_s"), (sl / SECOND).alias("t_sl_s"))
    return rows.withColumns(outcome_flags("outcome"))


def outcome_flags(outcome: str) -> dict[str, object]:
    """target, stop and timeout; an unknown outcome is none of them."""
    return {n: F.coalesce(F.col(outcome) == v, F.lit(False)).cast("int") for n, v in (("target", 1), ("stop", -1), ("timeout", 0))}


def target_summary(df: DataFrame, binary: Sequence[str], excursion: Sequence[str]) -> DataFrame:
    """A row a target: kind, share of ones or mean, std, min, median, max."""
    parts = []
    for kind, names in (("binary", binary), ("excursion", excursion)):
        if names:
            items = F.array(*(F.struct(F.lit(n).alias("target"), F.col(n).cast("double").alias("x")) for n in names))
            rows = df.select(F.explode(items).alias("i")).select("i.*")
            found = rows.groupBy("target").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
            found = with_quantiles(found, F.col("x"), [0.5], ["target"], "__q", rows)
            parts.append(found.select("target", F.lit(kind).alias("kind"), "mean", "std", "min", F.col("__q")[0].alias("median"), "max"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
