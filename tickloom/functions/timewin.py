"""Ordered windows: row frames, as-of lookups by union, prefix sums, runs and ranks. Time is ts_us (epoch microseconds)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SECOND = 1_000_000
BY, ORDER = ("inst_id",), ("ts_us", "event_id")


def ordered(by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def with_rn(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(ordered(by, order)).cast("bigint"))


def numbered(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER, out: str = "rn", bucket: int = 3600 * SECOND) -> DataFrame:
    """with_rn (as column `out`), counted within time buckets whose offsets come from their totals, so one instrument is not one task. order must be unique in
    an instrument if runs are to agree. Rows without a time are one bucket, the first."""
    dealt = df.withColumn("__b", F.coalesce(F.floor(F.col(order[0]) / bucket), F.lit(-(1 << 62))))
    before = Window.partitionBy(*(f"__k{i}" for i in range(len(by)))).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__b").alias("__c")).agg(F.count("*").alias("__t"))
    offsets = totals.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    rn = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) + F.col("__o")
    # offsets are one row a bucket: broadcast, so that rows are shuffled once, for the window
    return dealt.join(F.broadcast(offsets), [*same, F.col("__b") == F.col("__c")]).select(*df.columns, rn.cast("bigint").alias(out))


def time_bucket(df: DataFrame, column: str = "ts_us", rows: int = 1 << 16, most: int = 3600 * SECOND) -> int:
    """Microseconds of a time bucket that holds some `rows` rows of df on average, `most` at most: where many rows share little time, buckets of an hour
    would be an instrument each. Reads one column once."""
    n, a, z = df.agg(F.count(column), F.min(column), F.max(column)).first()
    return most if not n else max(1, min(most, (z - a + 1) * rows // n))


def in_row_blocks(
    df: DataFrame, build: Callable[[DataFrame, WindowSpec], DataFrame], before: int = 0, after: int = 0, by: Sequence[str] = BY, order: Sequence[str] = ORDER, block: int = 1 << 16, rn: str | None = None, bucket: int = 3600 * SECOND
) -> DataFrame:
    """build(rows, window): columns that look at most `before` rows back and `after` rows ahead, over blocks of an instrument's consecutive
    rows instead of all of them. A block gets so many rows of its neighbours, which are dropped after build. rn: keep the row's number as this column. bucket: see numbered."""
    block = max(block, 2 * before, 2 * after)
    rows = numbered(df, by, order, "__rn", bucket)
    own, place = F.floor((F.col("__rn") - 1) / block), F.pmod(F.col("__rn") - 1, F.lit(block))
    near = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    near += [F.when(place >= block - before, F.struct((own + 1).alias("b"), F.lit(False).alias("own")))] if before else []
    near += [F.when(place < after, F.struct((own - 1).alias("b"), F.lit(False).alias("own")))] if after else []
    dealt = rows.withColumn("__d", F.explode(F.array_compact(F.array(*near)))).withColumns({"__blk": F.col("__d.b"), "__own": F.col("__d.own")}).drop("__d")
    built = build(dealt, Window.partitionBy(*by, "__blk").orderBy("__rn"))
    built = built.where("__own").drop("__blk", "__own")
    return built.withColumnRenamed("__rn", rn) if rn else built.drop("__rn")


def full_frame(agg: Column, over: WindowSpec, rows: int, value: Column | None = None) -> Column:
    """agg over the last `rows` rows, NULL until there are as many (values, if one is given)."""
    frame = over.rowsBetween(1 - rows, 0)
    return F.when(F.count(F.lit(1) if value is None else value).over(frame) >= rows, agg.over(frame))


def carried_last(
    df: DataFrame, valued: DataFrame, value: str, key: str, ties: Sequence[str], order: Sequence[Column], out: str, by: Sequence[str] = BY, back: bool = True, bucket: int = 3600 * SECOND
) -> DataFrame:
    """df with `out`: the last non-NULL `value` up to and with the row, in `order` within `by`; back: key ascends, else it descends.

    A scan in two passes over buckets of `key`: the last value of each bucket, which is one row, is carried over the buckets that follow, and
    rows then look within their own bucket first. No window sorts more than a bucket. valued: the rows of df with a value, with `key` and `ties`
    (columns that order rows of equal key as `order` does). Rows without a key are one bucket, the first.
    """
    at = F.coalesce(F.floor(F.col(key) / bucket), F.lit(-(1 << 62) if back else 1 << 62))
    pick, turn = (F.max_by, F.asc) if back else (F.min_by, F.desc)
    keyed = {c: f"__by{i}" for i, c in enumerate(by)}
    lasts = valued.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in keyed.items()), at.alias("__at"))
    lasts = lasts.agg(pick(F.struct(F.col(value).alias("v")), F.struct(key, *ties)).alias("__carry"))
    # a bucket without values needs the carry too, so buckets are those of df
    places = df.select(*(F.col(c).alias(k) for c, k in keyed.items()), at.alias("__at")).distinct()
    same = [F.col(f"__p.{k}").eqNullSafe(F.col(f"__l.{k}")) for k in (*keyed.values(), "__at")]
    both = places.alias("__p").join(lasts.alias("__l"), reduce(lambda x, y: x & y, same), "left").select("__p.*", "__carry")
    before = Window.partitionBy(*keyed.values()).orderBy(turn("__at")).rowsBetween(Window.unboundedPreceding, -1)
    carries = both.select(*keyed.values(), F.col("__at").alias("__cat"), F.last("__carry", ignorenulls=True).over(before).alias("__carry"))
    own = Window.partitionBy(*by, "__at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn("__at", at).withColumn("__own", F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(own))
    met = [F.col(c).eqNullSafe(F.col(k)) for c, k in keyed.items()] + [F.col("__at") == F.col("__cat")]
    return seen.join(F.broadcast(carries), reduce(lambda x, y: x & y, met), "left").select(*df.columns, F.coalesce("__own", "__carry")["v"].alias(out))


def asof(
    probes: DataFrame,
    points: DataFrame,
    probe_key: Column,
    point_key: Column,
    value: Column,
    direction: str = "backward",
    by: Sequence[str] = BY,
    tie: Sequence[str] = ("event_id",),
    out: str = "found",
    reach: int | None = None,
) -> DataFrame:
    """probes with column `out`: `value` of the last point whose key is at or below probe_key (backward), or of the first one at
    or above it (forward). Among points of equal key, the last or first by `tie`, columns of points.

    A union whose last values are carried from one time bucket to the next (carried_last), so one instrument is spread over many tasks
    whatever the distance. With reach (microseconds; no point farther away is wanted) rows are dealt by time buckets of that length and
    each point is given to the next bucket too: one shuffle and one growing last-value window.
    """
    back = direction == "backward"
    struct = F.struct(*(F.col(c) for c in probes.columns))
    a = probes.select(*by, probe_key.alias("__k"), F.lit(1).alias("__p"), struct.alias("__row"))
    b = points.select(*by, point_key.alias("__k"), F.lit(0).alias("__p"), F.struct(value.alias("v")).alias("__v"), *(F.col(c).alias(f"__t{i}") for i, c in enumerate(tie)))
    turn = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    order = [turn("__k"), F.col("__p").asc(), *(turn(f"__t{i}") for i in range(len(tie)))]
    if not reach:
        both = a.unionByName(b, allowMissingColumns=True)
        found = carried_last(both, b, "__v", "__k", [f"__t{i}" for i in range(len(tie))], order, "__f", by, back).where("__p = 1")
        return found.select("__row.*", F.col("__f.v").alias(out))
    bucket = F.floor(F.col("__k") / reach)
    a = a.withColumn("__b", bucket)
    b = b.withColumn("__b", F.explode(F.array(bucket, bucket + (1 if back else -1))))
    both = a.unionByName(b, allowMissingColumns=True)
    over = Window.partitionBy(*by, "__b").orderBy(*order)
    found = F.last("__v", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__f", found).where("__p = 1").select("__row.*", F.col("__f.v").alias(out))


def prefix_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = BY, order: Sequence[str] = ORDER, bucket: int = 3600 * SECOND) -> DataFrame:
    """df with cum_<c>: the sum of c up to and with the row. Summed within time buckets, whose offsets come from their totals,
    so one instrument is not one task."""
    dealt = df.withColumn("__b", F.floor(F.col(order[0]) / bucket))
    totals = dealt.groupBy(*by, "__b").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"__k{i}" for i, c in enumerate((*by, "__b"))}
    offsets = totals.select(*(F.col(c).alias(k) for c, k in keys.items()), *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()))  # rows without an instrument or a time stay
    own = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *(F.sum(c).over(own).alias(f"__s_{c}") for c in columns)).join(F.broadcast(offsets), same)
    return summed.select(*df.columns, *((F.coalesce(f"__s_{c}", F.lit(0)) + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in columns))


def value_sums(df: DataFrame, key: str, columns: Sequence[str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """df, one row a value of the numeric `key`, with cum_<c>: the sum of c over the rows up to and with this one in the order of key.

    Rows are dealt into buckets between approximate quantiles of key (fewer than `buckets` numbers, taken to the driver as constants, so
    every use of them agrees); each bucket is summed by itself and its offset comes from the totals, one row a bucket. NULL keys must be gone.
    """
    edges = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))

    def place(low: int, high: int) -> Column:  # how many edges lie below key, by halving
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(key) > edges[middle], place(middle + 1, high)).otherwise(place(low, middle))

    dealt = df.withColumn("__b", place(0, len(edges)))
    totals = dealt.groupBy("__b").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    side = F.desc if descending else F.asc
    before = Window.orderBy(side("__b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns))
    own = Window.partitionBy("__b").orderBy(side(key)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *(F.sum(c).over(own).alias(f"__s_{c}") for c in columns)).join(F.broadcast(offsets), "__b")
    return summed.select(*df.columns, *((F.coalesce(f"__s_{c}", F.lit(0)) + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in columns))


def past_start(df: DataFrame, seconds: float, value: Column, out: str = "start", by: Sequence[str] = BY) -> DataFrame:
    """df with `out`: value at the first row whose time is at or after ts - seconds; NULL if the instrument's first row is later."""
    w = int(seconds * SECOND)
    first = F.min("ts_us").over(Window.partitionBy(*by))
    found = asof(df.withColumn("__first", first), df, F.col("ts_us") - w, F.col("ts_us"), value, "forward", by, out="__hit", reach=max(w, SECOND))
    return found.withColumn(out, F.when(F.col("ts_us") - w >= F.col("__first"), F.col("__hit"))).drop("__first", "__hit")


def past_starts(rows: DataFrame, seconds: Sequence[int], value: Column, by: Sequence[str] = BY) -> DataFrame:
    """(by, rn, s_<w> for each window): past_start's value for all windows at once. rows has by, ts_us, event_id, rn and what value needs.

    Probes and points of all windows meet in one union, dealt by (instrument, window, time bucket of the window's length), so one
    shuffle serves every window; only value and the row's number travel, and a second shuffle brings a row's windows together.
    """
    width = F.greatest(F.col("__w"), F.lit(1).cast("bigint")) * SECOND
    window = F.explode(F.array(*(F.lit(int(s)).cast("bigint") for s in seconds))).alias("__w")
    first = rows.groupBy(*(F.col(c).alias(f"__f{i}") for i, c in enumerate(by))).agg(F.min("ts_us").alias("__first"))
    a = rows.select(*by, "ts_us", "rn", window).join(first, [F.col(c).eqNullSafe(F.col(f"__f{i}")) for i, c in enumerate(by)])
    a = a.withColumn("__k", F.col("ts_us") - F.col("__w") * SECOND).where("__k >= __first").select(*by, "__w", "__k", "rn", F.lit(1).alias("__p"))
    b = rows.select(*by, window, F.col("ts_us").alias("__k"), F.lit(0).alias("__p"), F.col("event_id").alias("__t"), F.struct(value.alias("v")).alias("__v"))
    bucket = F.floor(F.col("__k") / width)
    both = a.withColumn("__b", bucket).unionByName(b.withColumn("__b", F.explode(F.array(bucket, bucket - 1))), allowMissingColumns=True)
    over = Window.partitionBy(*by, "__w", "__b").orderBy(F.desc("__k"), F.asc("__p"), F.desc("__t")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__f", F.last("__v", ignorenulls=True).over(over)).where("__p = 1")
    return found.groupBy(*by, "rn").agg(*(F.max(F.when(F.col("__w") == s, F.col("__f.v"))).alias(f"s_{s}") for s in seconds))


def forward_end(df: DataFrame, seconds: float, value: Column, out: str = "end", by: Sequence[str] = BY) -> DataFrame:
    """df with `out`: value at the last row whose time is at or before ts + seconds; NULL if that is after the last row."""
    w = int(seconds * SECOND)
    last = F.max("ts_us").over(Window.partitionBy(*by))
    found = asof(df.withColumn("__last", last), df, F.col("ts_us") + w, F.col("ts_us"), value, "backward", by, out="__hit", reach=max(w, SECOND))
    return found.withColumn(out, F.when(F.col("ts_us") + w <= F.col("__last"), F.col("__hit"))).drop("__last", "__hit")


def run_length(condition: Column, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> tuple[Column, Column]:
    """(island number, whether the row is in one): rows of consecutive true conditions share an island."""
    hit = F.coalesce(condition, F.lit(False))
    return F.sum(F.when(hit, 0).otherwise(1)).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)), hit


def average_rank_pct(column: str, by: Sequence[str] = ()) -> Column:
    """Rank of the non-NULL values with ties averaged, by their number."""
    here = Window.partitionBy(*by, F.col(column).isNull())
    rank = F.rank().over(here.orderBy(column))
    peers = F.count("*").over(Window.partitionBy(*by, column))
    return F.when(F.col(column).isNotNull(), (rank + (peers - 1) / 2) / F.count("*").over(here))


def with_average_rank_pct(df: DataFrame, column: str, out: str = "pct") -> DataFrame:
    """df with average_rank_pct over the whole table. Values are counted first, then joined back, so no task ranks the whole table."""
    per = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("__n"))
    total = per.agg(F.sum("__n").alias("__all"))
    ranks = value_sums(per, "__k", ["__n"]).crossJoin(F.broadcast(total))
    ranks = ranks.select("__k", ((F.col("cum___n") - (F.col("__n") - 1) / 2) / F.col("__all")).alias("__pct"))
    return df.join(ranks, F.col(column) == F.col("__k"), "left").select(*df.columns, F.col("__pct").alias(out))
