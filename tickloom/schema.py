"""Level columns, required-column checks and the NULL contract (NaN in, NULL inside)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 10
SIDES = ("bid", "ask")


def level(side: str, what: str, i: int) -> str:
    return f"{side}_{what}_{i:02d}"


def levels(side: str, what: str, k: int = DEPTH) -> list[str]:
    return [level(side, what, i) for i in range(1, k + 1)]


def book_columns(depth: int = DEPTH) -> list[str]:
    return [level(s, w, i) for i in range(1, depth + 1) for s in SIDES for w in ("px", "sz")]


def depth_of(df: DataFrame) -> int:
    """How many levels df has, by the names of its columns."""
    return max((int(m[1]) for c in df.columns if (m := re.fullmatch(r"bid_px_(\d+)", c))), default=0)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def safe_divide(a: Column, b: Column) -> Column:
    """NULL unless both are finite and b is not zero."""
    inf = F.lit(float("inf"))
    fine = (F.abs(a) < inf) & (F.abs(b) < inf) & (b != 0)
    return F.when(fine, F.try_divide(a, b))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def float_divide(a: Column, b: Column) -> Column:
    """Division as floating point has it, also where ANSI is on: by zero an infinity, zero by zero NaN."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.nullif(b, F.lit(0.0)))


def float_ln(x: Column) -> Column:
    """Natural logarithm as floating point has it: minus infinity at zero. Below zero it is NULL."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def round_scaled(x: Column, places: int) -> Column:
    """x times a power of ten, rounded half away from zero, and divided again, as DuckDB rounds: F.round rounds the decimal digits that a double prints as, which
    differs where x lies next to a half, and forgets the sign of what it rounds to zero."""
    scale = F.lit(10.0**places)
    whole = F.round(x * scale)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).when(whole == 0, x * 0.0).otherwise(whole / scale)


def prepare(df: DataFrame, time_col: str = "ts_event", needed: Iterable[str] = ("mid_px", "spread_px"), numeric: Iterable[str] = ()) -> DataFrame:
    """Input of the builders: times and numbers coerced (what does not parse is NULL), rows without a needed value dropped."""
    needed = list(needed)
    require(df, [time_col, *needed])
    out = df.withColumn(time_col, F.col(time_col).try_cast("timestamp"))
    for c in dict.fromkeys([*needed, *numeric]):
        out = out.withColumn(c, F.col(c).try_cast("double"))
    return nan_to_null(out).dropna(subset=[time_col, *needed]).withColumn("ts_us", F.unix_micros(time_col))


def downcast(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
