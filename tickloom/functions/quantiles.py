"""Exact, interpolated percentiles without a buffer of all distinct values in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells a factor of e: values of one cell differ by 1/4096 of themselves at most. Cells shape the work, never the result.
CELLS = 4096


def cell(v: Column) -> Column:
    """The value's cell, rising with the value: its logarithm in steps of 1/CELLS, mirrored for negative values; NaN comes last, as in a sort."""
    far = F.lit(1 << 40).cast("bigint")
    size = F.when(F.abs(v) == float("inf"), far).otherwise(F.floor(F.ln(F.abs(v)) * CELLS) + 1000 * CELLS)  # logarithms lie between -745 and 710
    return F.when(F.isnan(v), far + 1).when(v == 0, F.lit(0).cast("bigint")).otherwise(F.signum(v).cast("bigint") * size)


def quantiles(df: DataFrame, value: Column, points: Sequence[float], by: Sequence[str] = (), out: str = "q", weight: Column | None = None) -> DataFrame:
    """(by, out): the percentiles of the known values at `points` (0 .. 1), an array of doubles in that order, as F.percentile gives
    them (weight: how often a row counts). A group without a known value has no row; without `by`, one row with NULL instead.

    Two passes: rows are counted by cell, combined before the shuffle, and running counts say which cells hold the wanted ranks; then
    only the distinct values of those cells are counted and sorted, each cell by itself.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    group = F.struct(*keys) if keys else F.lit(0)
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    rows = df.select(*named, value.cast("double").alias("__v"), (F.lit(1) if weight is None else weight).cast("bigint").alias("__w")).where("__v is not null")
    rows = rows.select(group.alias("__g"), cell(F.col("__v")).alias("__b"), "__v", "__w")
    totals = rows.groupBy("__g", "__b").agg(F.sum("__w").alias("__t"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__g", "__b", "__t", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"), F.sum("__t").over(whole).alias("__all"))
    at = [(F.col("__all") - 1) * float(p) for p in points]
    ranks = [f(a) for a in at for f in (F.floor, F.ceil)]
    wanted = offsets.where(reduce(or_, ((r >= F.col("__o")) & (r < F.col("__o") + F.col("__t")) for r in ranks)))
    counted = rows.groupBy("__g", "__b", "__v").agg(F.sum("__w").alias("__n"))
    near = counted.join(wanted if keys else F.broadcast(wanted), ["__g", "__b"])  # without groups, two rows a point at most
    own = Window.partitionBy("__g", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__c", F.col("__o") + F.sum("__n").over(own))
    held = lambda r: F.max(F.when((r < F.col("__c")) & (r >= F.col("__c") - F.col("__n")), F.col("__v")))
    found = near.groupBy(*(["__g"] if keys else [])).agg(
        F.max("__all").alias("__all"), *(f for i in range(len(points)) for f in (held(ranks[2 * i]).alias(f"__lo{i}"), held(ranks[2 * i + 1]).alias(f"__hi{i}")))
    )

    def between(i: int) -> Column:
        lo, hi, pos = F.col(f"__lo{i}"), F.col(f"__hi{i}"), at[i]
        return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)

    result = F.when(F.col("__all").isNotNull(), F.array(*(between(i) for i in range(len(points))))).alias(out)
    return found.select(*(F.col("__g")[k].alias(c) for k, c in zip(keys, by, strict=True)), result)


def with_quantiles(df: DataFrame, value: Column, points: Sequence[float], by: Sequence[str] = (), out: str = "q", of: DataFrame | None = None) -> DataFrame:
    """df with `out`, the quantiles of its group (NULL where no value is known), of `of` where that is given."""
    found = quantiles(df if of is None else of, value, points, by, out)
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row
    other = found.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), out)
    return df.join(other, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], "left").select(*df.columns, out)
