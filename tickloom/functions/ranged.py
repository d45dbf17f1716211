"""Order over a whole table without one task for a group: rows dealt by ranges, numbered by part and place, offsets from the parts' totals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs))


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column | None = None, out: str = "place", total: str = "total") -> DataFrame:
    """df with `out`, the sum of weight (a row counts 1 if none is given) over the rows of its group up to and with it in `order`, and `total`,
    that of its group.

    Rows are dealt by ranges of (by, order), rows equal in these by a seeded number, and written once; a part sums its own rows, and each
    run of a group in a part begins with what the parts before hold, which is one row a run. NULLs come first and are a group of their own.
    """
    keys = [*by, *order, "__spread"]
    rows = df.withColumns({"__w": F.lit(1) if weight is None else weight, "__spread": F.rand(17)}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.drop("__spread").select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__no")), "ranged")
    runs = rows.groupBy("__part", *by).agg(F.sum("__w").alias("__held"))
    whole = Window.partitionBy(*by)
    names = {c: f"__k{i}" for i, c in enumerate(("__part", *by))}
    runs = runs.select(
        *(F.col(c).alias(n) for c, n in names.items()), (F.sum("__held").over(whole.orderBy("__part")) - F.col("__held")).alias("__before"), F.sum("__held").over(whole).alias(total)
    )
    own = Window.partitionBy("__part", *by).orderBy("__no").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn(out, F.sum("__w").over(own)).join(runs, _same(list(names.items())))
    return met.select(*df.columns, (F.col(out) + F.col("__before")).alias(out), total)


def with_average_rank_pct_by(df: DataFrame, column: str, by: Sequence[str], out: str = "pct") -> DataFrame:
    """df with `out`: the rank of the non-NULL values within `by`, ties averaged, by their number. Values are counted first, so that rows are never
    sorted or gathered by group; the counts, one row a group and value, are ranked by ranges, written and joined back."""
    per = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    ranks = ranged(per, by, [column], F.col("__n"), "__below", "__all")
    names = {c: f"__r{i}" for i, c in enumerate((*by, column))}
    pct = (F.col("__below") - (F.col("__n") - 1) / 2) / F.col("__all")
    ranks = cut(ranks.select(*(F.col(c).alias(n) for c, n in names.items()), pct.alias("__pct")), "ranks")
    return df.join(ranks, _same(list(names.items())), "left").select(*df.columns, F.col("__pct").alias(out))


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, int]], block: int = 1 << 16) -> DataFrame:
    """df with neighbours in `order` within `by`: columns maps a name to (column, how many rows ahead; negative: back). Blocks of `block` rows with a halo."""
    reach = max(abs(k) for _, k in columns.values())
    rows = ranged(df, by, order, out="__place", total="__n")
    own, at = F.floor((F.col("__place") - 1) / block), F.pmod(F.col("__place") - 1, F.lit(block))
    near = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    near += [F.when(at >= block - reach, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))), F.when(at < reach, F.struct((own - 1).alias("b"), F.lit(False).alias("own")))]
    dealt = rows.withColumn("__d", F.explode(F.array_compact(F.array(*near))))
    over = Window.partitionBy(*by, "__d.b").orderBy("__place")
    return dealt.select("*", *(F.lead(c, k).over(over).alias(n) if k > 0 else F.lag(c, -k).over(over).alias(n) for n, (c, k) in columns.items())).where("__d.own").select(*df.columns, *columns)


def digamma(x: Column) -> Column:
    """The digamma function of positive numbers, to 1e-13: shifted up by eight, then its asymptotic series."""
    z = x + 8.0
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, F.lit(4))) - 1 / (252 * F.pow(z, F.lit(6))) + 1 / (240 * F.pow(z, F.lit(8))) - 5 / (660 * F.pow(z, F.lit(10)))
    return series - reduce(lambda a, b: a + b, (1 / (x + float(i)) for i in range(8)))


def nearest_information(df: DataFrame, features: Sequence[str], y: str, k: int = 3) -> DataFrame:
    """(feature, n, mutual_info): mutual information in nats between each numeric feature and the discrete y, by nearest neighbours (Ross 2014).

    For a row, r is the distance to its k-th nearest value among rows of its own label (fewer where the label has fewer rows), m the number of
    all rows nearer than r (on the k-th neighbour's side those before its value, on the other those within x -+ r; where r is 0, all rows of the
    same value), itself included; the estimate is digamma(n) + <digamma(k)> - <digamma(rows of the label)> - <digamma(m)>, not below zero.
    Rows without a value or a label, and labels of one row, do not count. All features go in one long form: one ordering by
    (feature, label, value) for the neighbours, one by (feature, value) for the counts, both dealt by ranges.
    """
    items = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col("`" + c.replace("`", "``") + "`").cast("double").alias("x")) for c in features)))
    long = df.select(F.col(y).alias("y"), items.alias("f")).select("f.feature", "f.x", "y").where("x is not null and not isnan(x) and y is not null")
    sizes = long.groupBy("feature", "y").agg(F.count("*").alias("n_label")).where("n_label > 1")
    known = long.join(sizes, ["feature", "y"])
    sides = {f"__{side}{i}": ("x", i if side == "next" else -i) for side in ("next", "last") for i in range(1, k + 1)}
    near = in_ranges(known, ["feature", "y"], ["x"], sides)
    distances = F.array_sort(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c) - F.col("x")).alias("d"), F.col(c).alias("v"))) for c in sides))))
    used = F.least(F.lit(k), F.col("n_label") - 1).cast("int")
    far = near.select("feature", "x", "n_label", used.alias("k"), F.element_at(distances, used).alias("e"))
    r, v, x = F.col("e.d"), F.col("e.v"), F.col("x")
    lo = F.when(r == 0, x).when(v < x, v).otherwise(x - r)
    hi = F.when(r == 0, x).when(v > x, v).otherwise(x + r)
    # values below lo, or up to lo where r is more than 0, are outside; a bound counts the points that come before it
    far = far.select("feature", "x", "n_label", "k", lo.alias("lo"), hi.alias("hi"), (r == 0).alias("tied"), F.monotonically_increasing_id().alias("id"))
    far = cut(far, "neighbours")
    points = far.select("feature", F.col("x").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("point"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("int").alias("side"))
    before, after = F.lit(0), F.lit(2)
    lows = far.select("feature", F.col("lo").alias("at"), F.when(F.col("tied"), before).otherwise(after).alias("turn"), F.lit(0).alias("point"), "id", F.lit(-1).alias("side"))
    highs = far.select("feature", F.col("hi").alias("at"), F.when(F.col("tied"), after).otherwise(before).alias("turn"), F.lit(0).alias("point"), "id", F.lit(1).alias("side"))
    counted = ranged(points.union(lows).union(highs), ["feature"], ["at", "turn"], F.col("point"), "below", "n").where("point = 0")
    m = counted.groupBy("feature", "id").agg(F.sum(F.col("side") * F.col("below")).alias("m"), F.first("n").alias("n"))
    rows = far.select("feature", "id", "k", "n_label").join(m, ["feature", "id"])
    mean = lambda c: F.avg(digamma(F.col(c).cast("double")))
    found = rows.groupBy("feature").agg(F.first("n").alias("n"), (mean("k") - mean("n_label") - mean("m")).alias("rest"))
    return found.select("feature", "n", F.greatest(F.lit(0.0), digamma(F.col("n").cast("double")) + F.col("rest")).alias("mutual_info"))
