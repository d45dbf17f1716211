"""Quantile and fixed bins. Edges are exact, interpolated percentiles; bins are closed on the right, the lowest edge is in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles, with_quantiles


def right_closed(x: Column, edges: Column, n: int) -> Column:
    """0-based bin of x among an array of at most n + 1 rising edges; NULL outside."""
    out = F.when(x == edges[0], 0)
    for i in range(n):
        out = out.when((F.size(edges) > i + 1) & (x > F.get(edges, F.lit(i))) & (x <= F.get(edges, F.lit(i + 1))), i)
    return out


def tercile_bucket(df: DataFrame, column: str, out: str, q: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """0 .. q-1 by quantiles; all 0 if two edges coincide; NULL stays NULL. The edges are one row (or one a group `by`)."""
    found = with_quantiles(df, F.col(column), [i / q for i in range(q + 1)], by, "__edges")
    edges = F.col("__edges")
    code = F.when(F.size(F.array_distinct(edges)) < q + 1, F.when(F.col(column).isNotNull(), 0)).otherwise(right_closed(F.col(column), edges, q))
    return found.withColumn(out, code.cast("int")).drop("__edges")


def tercile_buckets(df: DataFrame, columns: dict[str, str], q: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """tercile_bucket of several columns (name of the bucket by column): one long form and one join for all edges, so df is planned
    no more often than for one column."""
    points = [i / q for i in range(q + 1)]
    items = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns))))
    keys = [f"__by{i}" for i in range(len(by))]
    long = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), items.alias("__c")).select(*keys, "__c.i", "__c.x")
    each = quantiles(long, F.col("x"), points, [*keys, "i"])
    edges = each.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"__edges{i}") for i in range(len(columns))))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    found = df.join(edges, on, "left") if by else df.crossJoin(F.broadcast(edges))
    codes = {}
    for i, (column, out) in enumerate(columns.items()):
        e = F.col(f"__edges{i}")
        codes[out] = F.when(F.size(F.array_distinct(e)) < q + 1, F.when(F.col(column).isNotNull(), 0)).otherwise(right_closed(F.col(column), e, q)).cast("int")
    return found.withColumns(codes).select(*df.columns, *codes)


def quantile_bin(df: DataFrame, column: str, out: str, q: int, by: Sequence[str] = (), of: DataFrame | None = None) -> DataFrame:
    """Bins by q quantiles (of `of`, where that is given), coinciding edges dropped."""
    found = with_quantiles(df, F.col(column), [i / q for i in range(q + 1)], by, "__edges", of).withColumn("__edges", F.array_distinct("__edges"))
    return found.withColumn(out, right_closed(F.col(column), F.col("__edges"), q).cast("int")).drop("__edges")


def fixed_bin(x: Column, edges: Sequence[float]) -> Column:
    return right_closed(x, F.array(*(F.lit(float(e)) for e in edges)), len(edges) - 1).cast("int")


def histogram(df: DataFrame, column: str, low: float, width: float) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.floor((F.col(column) - low) / width).alias("bin")).agg(F.count("*").alias("n"))
