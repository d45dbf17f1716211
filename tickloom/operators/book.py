"""Book replay as relations: deltas become validity intervals of levels, joined to the times at which a state is wanted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut
from ..functions.quantiles import with_quantiles
from ..functions.timewin import SECOND, carried_last
from ..schema import DEPTH, SIDES, level
from .replay import carried_replay

SEGMENT = ("inst_id", "seg_us")


def wide_to_levels(book: DataFrame, keep: tuple[str, ...] = ("inst_id", "ts_us"), depth: int = DEPTH) -> DataFrame:
    """(keep, side, level, price, size): a row a level; NULL prices and sizes at or below zero are no levels."""
    items = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(i).alias("level"), F.col(level(s, "px", i)).alias("price"), F.col(level(s, "sz", i)).alias("size")) for s in SIDES for i in range(1, depth + 1)))
    return book.select(*keep, F.explode(items).alias("l")).select(*keep, "l.*").where("price is not null and size > 0")


def levels_to_wide(rows: DataFrame, keys: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """One row a key: level columns, mid_px and spread_px (NULL if a side is empty). rows have side, level, price, size."""
    aggs = [
        F.max(F.when((F.col("side") == s) & (F.col("level") == i), F.col(src))).alias(level(s, what, i))
        for i in range(1, depth + 1) for s in SIDES for what, src in (("px", "price"), ("sz", "size"))
    ]
    wide = rows.where(F.col("level") <= depth).groupBy(*keys).agg(*aggs)
    bid, ask = F.col("bid_px_01"), F.col("ask_px_01")
    return wide.withColumns({"mid_px": (bid + ask) / 2, "spread_px": ask - bid})


def ranked(rows: DataFrame, keys: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """The best `depth` prices of each side: level 1 is the highest bid and the lowest ask."""
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return rows.withColumn("level", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(best))).where(F.col("level") <= depth)


def check_sides(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn("side", F.when(F.col("side").isin(*SIDES), F.col("side")).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce("side", F.lit("NULL"))))))


def validity(deltas: DataFrame, seq: tuple[str, ...] = ("seq",), segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(segment, side, price, size, from_us, until_us): the last write of a price at a time holds until the next one; size <= 0 ends it.
    until_us is NULL for what holds to the segment's end."""
    over = Window.partitionBy(*segment, "side", "price").orderBy("ts_us", *seq)
    nxt = F.lead("ts_us").over(over)
    return (
        deltas.withColumn("until_us", nxt).where("size > 0 and (until_us is null or until_us > ts_us)")
        .select(*segment, "side", "price", "size", F.col("ts_us").alias("from_us"), "until_us")
    )


def states(intervals: DataFrame, emits: DataFrame, depth: int = DEPTH, bucket_us: int = 3600 * SECOND, segment: tuple[str, ...] = SEGMENT, ends: Column | None = None) -> DataFrame:
    """(segment, ts_us, side, level, price, size): the best levels at each time of emits (segment, ts_us).

    The interval join is an equality join on time buckets: an interval is dealt to the buckets that it touches, within its
    segment's emits, and a time to its own one, so no pair is compared twice and none by a nested loop. Where many changes fall into a
    bucket its pairs grow with their square: carried_replay gives the same states in one pass.
    """
    spans = emits.groupBy(*segment).agg(F.min("ts_us").alias("__lo"), F.max("ts_us").alias("__hi"))
    lo, hi = F.greatest("from_us", "__lo"), F.least(F.coalesce(F.col("until_us") - 1, F.col("__hi")), "__hi")
    dealt = intervals.join(spans, list(segment)).withColumns({"__a": lo, "__z": hi}).where("__a <= __z")
    dealt = dealt.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__a") / bucket_us), F.floor(F.col("__z") / bucket_us)))).drop("__lo", "__hi", "__a", "__z")
    at = emits.select(*segment, "ts_us", F.floor(F.col("ts_us") / bucket_us).alias("__b"))
    live = at.join(dealt, [*segment, "__b"]).where("from_us <= ts_us and (until_us is null or ts_us < until_us)")
    return ranked(live.select(*segment, "ts_us", "side", "price", "size"), (*segment, "ts_us"), depth)


def event_emits(deltas: DataFrame, segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    return deltas.select(*segment, "ts_us").distinct()


def grid_emits(spans: DataFrame, step_us: int, segment: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Times start_us, start_us + step, ... up to end_us (both ends in) of each row of spans (segment, start_us, end_us)."""
    return spans.where("start_us <= end_us").select(*segment, F.explode(F.sequence("start_us", "end_us", F.lit(step_us))).alias("ts_us"))


def assign_segments(rows: DataFrame, snapshot_times: DataFrame) -> DataFrame:
    """rows with seg_us: the last snapshot time (inst_id, ts_us) at or before theirs; rows before the first are dropped. As of any
    distance, by values carried from one time bucket to the next."""
    struct = F.struct(*(F.col(c) for c in rows.columns))
    a = rows.select("inst_id", "ts_us", F.lit(1).alias("__p"), struct.alias("__row"))
    b = snapshot_times.select("inst_id", "ts_us", F.lit(0).alias("__p"), F.col("ts_us").alias("__s"))
    both = a.unionByName(b, allowMissingColumns=True)
    found = carried_last(both, b, "__s", "ts_us", ["__p"], [F.asc("ts_us"), F.asc("__p")], "seg_us")
    return found.where("__p = 1 and seg_us is not null").select("__row.*", "seg_us")


def segmented_replay(snapshot_levels: DataFrame, deltas: DataFrame, emits: DataFrame, depth: int = DEPTH, seq: tuple[str, ...] = ("seq",)) -> DataFrame:
    """States at emits (inst_id, ts_us), the book reset at every snapshot (inst_id, ts_us, side, price, size): wide rows."""
    times = snapshot_levels.select("inst_id", "ts_us").distinct()
    start = snapshot_levels.select("inst_id", F.col("ts_us").alias("seg_us"), "ts_us", "side", "price", "size", *(F.lit(-1).alias(c) for c in seq))
    changes = assign_segments(deltas, times).select("inst_id", "seg_us", "ts_us", "side", "price", "size", *seq)
    at = assign_segments(emits.select("inst_id", "ts_us"), times)
    found = carried_replay(start.unionByName(changes), at.distinct(), depth, seq)
    return found.where("bid_px_01 is not null or ask_px_01 is not null")


def raw_to_wide(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Long snapshot rows (inst_id, ts_us, side, level, price, size) to wide ones; levels outside 1 .. depth are ignored."""
    return levels_to_wide(rows.where(F.col("level").between(1, depth)), ("inst_id", "ts_us"), depth)


def crossed() -> Column:
    return F.coalesce(F.col("bid_px_01") >= F.col("ask_px_01"), F.lit(False))


def chunk_ranges(start_us: int, end_us: int, hours: int) -> list[tuple[int, int]]:
    step = hours * 3600 * SECOND
    return [(a, min(a + step, end_us)) for a in range(start_us, end_us, step)]


def to_long(book: DataFrame, depth: int = DEPTH, keys: tuple[str, ...] = ("inst_id", "ts_us")) -> DataFrame:
    """(keys, level, side, price, size) for heat maps: every level whose columns are there, up to the first level without
    them; levels with NULL prices or sizes stay."""
    have = next((i - 1 for i in range(1, depth + 1) if level("bid", "px", i) not in book.columns), depth)
    items = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(s).alias("side"), F.col(level(s, "px", i)).alias("price"), F.col(level(s, "sz", i)).alias("size")) for i in range(1, have + 1) for s in SIDES))
    return book.select(*keys, F.explode(items).alias("l")).select(*keys, "l.*")


def padded_levels(rows: DataFrame, depth: int = DEPTH, keys: tuple[str, ...] = ("inst_id", "ts_us")) -> DataFrame:
    """Level rows filled up with NULL levels, so that each key has `depth` levels of both sides."""
    slots = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(i).alias("level")) for s in SIDES for i in range(1, depth + 1))))
    every = rows.select(*keys).distinct().select(*keys, slots.alias("s")).select(*keys, "s.*")
    return every.join(rows.select(*keys, "side", "level", "price", "size"), [*keys, "side", "level"], "left")


def chunk_segments(snapshot_times: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """(inst_id, seg_us, next_us, out_start, out_end) of a chunk: the last snapshot at or before its start and those in (start, end].
    A segment goes up to the next one's start (not in it), the last one to the chunk's end (in it; next_us is NULL). Instruments
    without a snapshot at or before the start have none."""
    t = F.col("ts_us")
    anchor = F.max(F.when(t <= start_us, t)).over(Window.partitionBy("inst_id"))
    used = snapshot_times.select("inst_id", "ts_us").distinct().withColumn("__a", anchor).where(F.col("__a").isNotNull() & (t >= F.col("__a")) & (t <= end_us))
    nxt = F.lead("ts_us").over(Window.partitionBy("inst_id").orderBy("ts_us"))
    return used.select("inst_id", t.alias("seg_us"), nxt.alias("next_us"), F.greatest(t, F.lit(start_us)).alias("out_start"), F.coalesce(nxt, F.lit(end_us)).alias("out_end"))


def aligned_start(at: Column, start_us: int, step_us: int) -> Column:
    """The first time of the chunk's grid (start, start + step, ...) at or after `at`."""
    return F.lit(start_us) + F.ceil(F.greatest(at - start_us, F.lit(0)) / step_us) * step_us


def reconstruct_chunk(
    snapshot_levels: DataFrame, deltas: DataFrame, start_us: int, end_us: int, mode: str = "event", step_us: int = SECOND // 10,
    policy: str = "snapshot_to_snapshot", depth: int = DEPTH, seq: tuple[str, ...] = ("seq",), bucket_us: int | None = None, bucket_rows: int = 50_000,
) -> DataFrame:
    """Flat records of all instruments in [start, end]: level columns, mid_px, spread_px, anchor_snapshot_us, reconstruction_mode.

    policy snapshot_to_snapshot resets the book at every snapshot (chunk_segments), single keeps the anchor's book. event emits at
    every time of a delta, and a segment without deltas once, at its start; grid emits on the chunk's grid. Segments do not
    overlap, so a time of an instrument comes once. Instruments without an anchor give nothing. bucket_rows: see carried_replay;
    bucket_us is of no use any more.
    """
    if mode not in ("event", "grid") or policy not in ("snapshot_to_snapshot", "single"):
        raise ValueError(f"unknown mode {mode!r} or policy {policy!r}")
    segments = chunk_segments(snapshot_levels, start_us, end_us)
    if policy == "single":
        segments = segments.where(F.col("seg_us") <= start_us).withColumns({"next_us": F.lit(None).cast("bigint"), "out_end": F.lit(end_us)})
    times = segments.select("inst_id", F.col("seg_us").alias("ts_us"))
    opening = snapshot_levels.join(times, ["inst_id", "ts_us"], "left_semi").select("inst_id", F.col("ts_us").alias("seg_us"), "ts_us", "side", "price", "size", *(F.lit(-1).alias(c) for c in seq))
    changes = assign_segments(deltas.where(F.col("ts_us") <= end_us), times).select("inst_id", "seg_us", "ts_us", "side", "price", "size", *seq)
    if mode == "event":
        own = changes.select(*SEGMENT, "ts_us").distinct()
        idle = segments.join(own.select(*SEGMENT).distinct(), list(SEGMENT), "left_anti").select(*SEGMENT, F.col("out_start").alias("ts_us"))
        emits = own.where(F.col("ts_us") >= start_us).unionByName(idle)
    else:
        spans = segments.select(*SEGMENT, "next_us", aligned_start(F.col("out_start"), start_us, step_us).alias("start_us"), F.col("out_end").alias("end_us"))
        emits = spans.where("start_us <= end_us").select(*SEGMENT, "next_us", F.explode(F.sequence("start_us", "end_us", F.lit(step_us))).alias("ts_us"))
        emits = emits.where("next_us is null or ts_us < next_us").drop("next_us")
    rows = carried_replay(opening.unionByName(changes), emits, depth, seq, bucket_rows)
    return rows.withColumnRenamed("seg_us", "anchor_snapshot_us").withColumn("reconstruction_mode", F.lit(mode))


def segment_check(records: DataFrame, snapshots: DataFrame, depth: int = DEPTH, tol: float = 1e-9) -> DataFrame:
    """The last record of each segment against the next snapshot (wide rows): best prices match within tol (a missing one counts as a
    match), greatest price and size differences of levels that both have."""
    last = records.groupBy("inst_id", "anchor_snapshot_us").agg(F.max_by(F.struct(*(F.col(c) for c in records.columns)), "ts_us").alias("r"))
    following = last.withColumn("next_us", F.lead("anchor_snapshot_us").over(Window.partitionBy("inst_id").orderBy("anchor_snapshot_us"))).where("next_us is not null")
    wide = snapshots.select(F.col("inst_id").alias("__i"), F.col("ts_us").alias("__t"), F.struct(*(F.col(level(s, w, i)) for s in SIDES for w in ("px", "sz") for i in range(1, depth + 1))).alias("n"))
    both = following.join(wide, (F.col("inst_id") == F.col("__i")) & (F.col("next_us") == F.col("__t")))
    diff = lambda c: F.abs(F.col(f"r.{c}") - F.col(f"n.{c}"))
    widest = lambda w: F.array_max(F.array(*(diff(level(s, w, i)) for s in SIDES for i in range(1, depth + 1))))
    match = lambda s: F.coalesce(diff(level(s, "px", 1)) <= tol, F.lit(True))
    return both.select("inst_id", F.col("r.ts_us").alias("last_us"), "next_us", match("bid").alias("top1_bid_match"), match("ask").alias("top1_ask_match"), widest("px").alias("max_px_diff"), widest("sz").alias("max_sz_diff"))


def dry_run(snapshot_levels: DataFrame, deltas: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """(start_us, end_us, inst_id, anchor_us, n_snapshots, n_deltas) of each chunk: what a reconstruction would read."""
    spark = deltas.sparkSession
    chunks = F.broadcast(spark.createDataFrame(ranges, "start_us bigint, end_us bigint"))
    t = snapshot_levels.select("inst_id", "ts_us").distinct().join(chunks, F.col("ts_us") <= F.col("end_us"))
    a = t.groupBy("start_us", "end_us", "inst_id").agg(F.max(F.when(F.col("ts_us") <= F.col("start_us"), F.col("ts_us"))).alias("anchor_us"), F.count_if(F.col("ts_us") > F.col("start_us")).alias("n_snapshots"))
    d = deltas.join(chunks, F.col("ts_us").between(F.col("start_us"), F.col("end_us"))).groupBy("start_us", "end_us", "inst_id").agg(F.count("*").alias("n_deltas"))
    return a.join(d, ["start_us", "end_us", "inst_id"], "full").na.fill(0, ["n_snapshots", "n_deltas"])


def reconstruct_job(snapshot_levels: DataFrame, deltas: DataFrame, path: str, ranges: list[tuple[int, int]], **options) -> DataFrame:
    """Reconstruct chunk by chunk under `path` (write_chunk), each chunk one Spark job over all instruments; (start_us, end_us, inst_id, anchor_us,
    n_deltas, n_rows, status) of every chunk and instrument, from the manifest under `path`.

    A chunk is in the manifest once its rows are written. A job that was stopped goes on with the chunks that are not; what a stopped one left
    of a chunk is replaced, so a second run gives the same rows. status: `written`, `no anchor` (no snapshot at or before the chunk's
    start), `no deltas` (none in the chunk; its snapshots' books are written in mode grid or where the chunk has snapshots of its own).
    Deltas before the earliest anchor of a chunk are not read.
    """
    from ..cuts import path_exists
    from ..sources.tables import write_chunk

    spark, manifest = deltas.sparkSession, f"{path.rstrip('/')}/_manifest"
    shape = "start_us bigint, end_us bigint, inst_id string, anchor_us bigint, n_deltas bigint, n_rows bigint, status string"
    name = lambda a, z: f"{a}-{z}"
    for a, z in ranges:
        if path_exists(spark, f"{manifest}/chunk={name(a, z)}/_SUCCESS"):
            continue
        at = snapshot_levels.where(F.col("ts_us") <= z).groupBy("inst_id").agg(F.max(F.when(F.col("ts_us") <= a, F.col("ts_us"))).alias("anchor_us"))
        first = at.agg(F.min("anchor_us")).first()[0]
        if first is not None:
            write_chunk(reconstruct_chunk(snapshot_levels.where(F.col("ts_us") >= first), deltas.where(F.col("ts_us") >= first), a, z, **options), path, name(a, z))
            rows = spark.read.parquet(path).where(F.col("chunk") == name(a, z)).select(F.col("inst_id").cast("string").alias("inst_id"))
        else:
            rows = spark.createDataFrame([], "inst_id string")
        own = deltas.where(F.col("ts_us").between(a, z)).groupBy("inst_id").agg(F.count("*").alias("n_deltas"))
        found = at.join(own, "inst_id", "full").join(rows.groupBy("inst_id").agg(F.count("*").alias("n_rows")), "inst_id", "left").na.fill(0, ["n_deltas", "n_rows"])
        status = F.when(F.col("anchor_us").isNull(), "no anchor").when(F.col("n_deltas") == 0, "no deltas").otherwise("written")
        found = found.select(F.lit(a).cast("bigint").alias("start_us"), F.lit(z).cast("bigint").alias("end_us"), F.col("inst_id").cast("string"), "anchor_us", "n_deltas", "n_rows", status.alias("status"))
        found.write.mode("overwrite").parquet(f"{manifest}/chunk={name(a, z)}")
    return spark.read.schema(shape).parquet(*(f"{manifest}/chunk={name(a, z)}" for a, z in ranges)) if ranges else spark.createDataFrame([], shape)


def compare_levels(real: DataFrame, rec: DataFrame, keys: tuple[str, ...] = ("inst_id", "ts_us"), tol: float = 1e-9) -> DataFrame:
    """Real against replayed level rows by key, side and level: best-price matches, greatest and mean differences of levels that both
    have, crossed flags and counts of sizes at or below zero."""
    a = real.select(*keys, "side", "level", F.col("price").alias("real_px"), F.col("size").alias("real_sz"))
    b = rec.select(*keys, "side", "level", F.col("price").alias("rec_px"), F.col("size").alias("rec_sz"))
    return _compared(a.join(b, [*keys, "side", "level"], "full"), keys, tol)


def compare_wide(real: DataFrame, rec: DataFrame, keys: tuple[str, ...] = ("inst_id", "ts_us"), depth: int = DEPTH, tol: float = 1e-9) -> DataFrame:
    """compare_levels of wide rows, rec with one row a key: rows are joined whole and their levels told apart afterwards, so that one shuffle of
    wide rows is all. NULL prices and sizes at or below zero are no levels."""

    found = lambda df, name: df.select(*keys, *_known_levels(name, "", depth))
    return _compared(_pairs(found(real, "real").join(found(rec, "rec"), list(keys), "full"), keys, depth), keys, tol)


def compare_paired(rows: DataFrame, keys: tuple[str, ...] = ("inst_id", "ts_us"), depth: int = DEPTH, tol: float = 1e-9) -> DataFrame:
    """compare_wide of wide rows that carry their replayed book as rec_<level column>: no join."""
    both = rows.select(*keys, *_known_levels("real", "", depth), *_known_levels("rec", "rec_", depth))
    return _compared(_pairs(both, keys, depth), keys, tol)


def _known_levels(name: str, prefix: str, depth: int) -> list[Column]:
    """(px, sz) of each level as <name>_<side>_<i>, NULL where the price is NULL or the size not above zero."""

    def known(s: str, i: int) -> Column:
        px, sz = (F.col(prefix + level(s, w, i)) for w in ("px", "sz"))
        return F.when(px.isNotNull() & (sz > 0), F.struct(px.alias("px"), sz.alias("sz"))).alias(f"{name}_{s}_{i}")

    return [known(s, i) for s in SIDES for i in range(1, depth + 1)]


def _pairs(met: DataFrame, keys: tuple[str, ...], depth: int) -> DataFrame:
    """A row a level that either side of met (real_<side>_<i>, rec_<side>_<i>) has."""
    parts = lambda n, s, i: (F.col(f"{n}_{s}_{i}.px").alias(f"{n}_px"), F.col(f"{n}_{s}_{i}.sz").alias(f"{n}_sz"))
    items = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(i).alias("level"), *parts("real", s, i), *parts("rec", s, i)) for s in SIDES for i in range(1, depth + 1)))
    return met.select(*keys, F.explode(items).alias("l")).select(*keys, "l.*").where("real_px is not null or rec_px is not null")


def _compared(both: DataFrame, keys: tuple[str, ...], tol: float) -> DataFrame:
    dpx, dsz = F.abs(F.col("real_px") - F.col("rec_px")), F.abs(F.col("real_sz") - F.col("rec_sz"))
    best = lambda s, c: F.max(F.when((F.col("side") == s) & (F.col("level") == 1), F.col(c)))
    top = lambda s: F.coalesce(F.max(F.when((F.col("side") == s) & (F.col("level") == 1), dpx <= tol)), F.lit(False))
    return both.groupBy(*keys).agg(
        F.max(dpx).alias("max_px_diff"), F.max(dsz).alias("max_sz_diff"), F.avg(dpx).alias("mean_px_diff"), F.avg(dsz).alias("mean_sz_diff"),
        top("bid").alias("top1_bid_match"), top("ask").alias("top1_ask_match"),
        F.coalesce(best("bid", "real_px") >= best("ask", "real_px"), F.lit(False)).alias("crossed_book_real"),
        F.coalesce(best("bid", "rec_px") >= best("ask", "rec_px"), F.lit(False)).alias("crossed_book_rec"),
        *(F.count_if(F.col(f"{w}_sz") <= 0).cast("int").alias(f"negative_or_zero_size_{w}") for w in ("real", "rec")),
        F.count(dpx).alias("n_compared"),
    )


def compare_forensic(real: DataFrame, rec: DataFrame, keys: tuple[str, ...] = ("inst_id", "ts_us")) -> DataFrame:
    """compare_levels over levels that both have only: greatest differences start at 0, a best price that one side lacks is no match."""
    found = compare_levels(real, rec, keys)
    return found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("max_px_diff", "max_sz_diff", "mean_px_diff", "mean_sz_diff")})


def grid_nearest(real: DataFrame, grid: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Snapshots (wide rows) against the last grid row at or before each: the comparison and how many microseconds the row is old."""
    from ..functions.timewin import asof

    probes = real.select("inst_id", "ts_us", F.struct(*(F.col(c) for c in real.columns)).alias("real"))
    found = asof(probes, grid.withColumn("__tie", F.lit(0)), F.col("ts_us"), F.col("ts_us"), F.struct(*(F.col(c) for c in grid.columns)), tie=("__tie",), out="rec").where("rec is not null")
    age = found.select("inst_id", "ts_us", (F.col("ts_us") - F.col("rec.ts_us")).alias("age_us"))
    rec = wide_to_levels(found.select("inst_id", "ts_us", *(F.col(f"rec.{c}") for c in grid.columns if c not in ("inst_id", "ts_us"))), depth=depth)
    return compare_levels(wide_to_levels(found.select("real.*"), depth=depth), rec).join(age, ["inst_id", "ts_us"])


def snapshot_aligned_run(snapshots: DataFrame, opening: DataFrame, deltas: DataFrame, k: int = 10, depth: int = DEPTH, **options) -> dict[str, DataFrame]:
    """points (every snapshot, wide rows, against the book replayed up to and with its time), summary, and the k worst points."""
    emits = snapshots.select("inst_id", "ts_us").distinct()
    rec = segmented_replay(opening, deltas, emits, depth, **options)
    points = compare_levels(wide_to_levels(snapshots, depth=depth), wide_to_levels(rec, depth=depth))
    return {"points": points, "summary": validation_summary(points), "worst": worst(points, k)}


def order_forensics(real: DataFrame, deltas: DataFrame, k: int, orders: dict[str, tuple[str, ...]], depth: int = DEPTH) -> DataFrame:
    """The k worst points under the first order, replayed under all orders, with a flag whether the last one is nearer to the snapshot."""
    names = list(orders)
    checked = replay_order_check(real, deltas, orders, depth)
    first, last = (F.col(f"max_px_diff_{n}") for n in (names[0], names[-1]))
    flagged = checked.withColumn("improved", F.coalesce(last < first, F.lit(False)))
    return flagged.orderBy(F.desc_nulls_last(first), "inst_id", "ts_us").limit(k)


def sampled_points(real: DataFrame, share: float, seed: int = 42, keys: tuple[str, ...] = ("inst_id", "ts_us")) -> DataFrame:
    """The keys of a seeded share of real's points: those whose hash lies below it, whatever else the table holds."""
    text = F.concat_ws("#", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys))
    spot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return real.select(*keys).distinct().where(spot < int(share * (1 << 32)))


def sampled_forensics(
    real: DataFrame, deltas: DataFrame, k: int, orders: dict[str, tuple[str, ...]], share: float = 0.1, seed: int = 42, depth: int = DEPTH, bucket_rows: int = 50_000
) -> DataFrame:
    """The k worst of a seeded sample of real's points (level rows) under the first order of the deltas within a time, and how they fare
    under the second: (inst_id, ts_us, max_px_diff_<order>, max_sz_diff_<order> of both, improved).

    Two phases: the sample is replayed once; the k worst points, a bounded table, are written, and only their instruments' deltas up to
    their last point are replayed again. improved: the price difference shrinks, or the size difference where prices stay."""
    (first, a), (second, b) = orders.items()

    def against(points: DataFrame, seq: tuple[str, ...], name: str) -> DataFrame:
        until = points.groupBy(F.col("inst_id").alias("__i")).agg(F.max("ts_us").alias("__until"))
        own = deltas.join(until, F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col("ts_us") <= F.col("__until"))).select(*deltas.columns)
        rec = carried_replay(own.withColumn("seg_us", F.lit(0)), points.withColumn("seg_us", F.lit(0)), depth, seq, bucket_rows)
        at = points.select(F.col("inst_id").alias("__i"), F.col("ts_us").alias("__t"))
        asked = real.join(at, F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col("ts_us") == F.col("__t")), "left_semi")
        found = compare_levels(asked, wide_to_levels(rec, depth=depth))
        return found.select("inst_id", "ts_us", F.col("max_px_diff").alias(f"max_px_diff_{name}"), F.col("max_sz_diff").alias(f"max_sz_diff_{name}"))

    px, sz = f"max_px_diff_{first}", f"max_sz_diff_{first}"
    worst_of = cut(against(sampled_points(real, share, seed), a, first).orderBy(F.desc_nulls_last(px), F.desc_nulls_last(sz), "inst_id", "ts_us").limit(k), "worst")
    again = against(worst_of.select("inst_id", "ts_us"), b, second).withColumnsRenamed({"inst_id": "__i", "ts_us": "__t"})
    both = worst_of.join(again, F.col("inst_id").eqNullSafe(F.col("__i")) & (F.col("ts_us") == F.col("__t"))).drop("__i", "__t")
    less = lambda what: F.col(f"max_{what}_diff_{second}") < F.col(f"max_{what}_diff_{first}")
    same = F.col(f"max_px_diff_{second}") == F.col(px)
    return both.withColumn("improved", F.coalesce(less("px") | (same & less("sz")), F.lit(False)))


def sanity_counters(points: DataFrame) -> DataFrame:
    """Crossed books, sizes at or below zero, match shares and worst differences over all compared points, one row."""
    return points.agg(
        F.count("*").alias("n"), F.count_if("crossed_book_real").alias("crossed_real"), F.count_if("crossed_book_rec").alias("crossed_rec"),
        F.sum("negative_or_zero_size_real").alias("empty_sizes_real"), F.sum("negative_or_zero_size_rec").alias("empty_sizes_rec"),
        F.avg((F.col("top1_bid_match") & F.col("top1_ask_match")).cast("int")).alias("match_share"), F.max("max_px_diff").alias("worst_px_diff"), F.max("max_sz_diff").alias("worst_sz_diff"),
    )


def validation_summary(points: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int"))
    worst_of = ("max_px_diff", "max_sz_diff")
    found = points.agg(
        F.count("*").alias("n"), rate("top1_bid_match").alias("bid_match_rate"), rate("top1_ask_match").alias("ask_match_rate"),
        *(f(c).alias(f"{n}_{c}") for c in worst_of for n, f in (("avg", F.avg), ("max", F.max))),
    )
    for c in worst_of:
        found = with_quantiles(found, F.col(c), [0.95], out=f"__{c}", of=points)
    return found.select("n", "bid_match_rate", "ask_match_rate", *(x for c in worst_of for x in (F.col(f"avg_{c}"), F.col(f"__{c}")[0].alias(f"p95_{c}"), F.col(f"max_{c}"))))


def worst(points: DataFrame, k: int) -> DataFrame:
    return points.orderBy(F.desc_nulls_last("max_px_diff"), F.desc_nulls_last("max_sz_diff"), "inst_id", "ts_us").limit(k)


def replay_order_check(real: DataFrame, deltas: DataFrame, orders: dict[str, tuple[str, ...]], depth: int = DEPTH) -> DataFrame:
    """The comparison under each named order of the deltas within a time, joined by key: does a fixed order improve the replay?"""
    times = real.select("inst_id", "ts_us").distinct()
    parts = []
    for name, seq in orders.items():
        found = carried_replay(deltas.withColumn("seg_us", F.lit(0)), times.withColumn("seg_us", F.lit(0)), depth, seq)
        parts.append(compare_levels(real, wide_to_levels(found, depth=depth)).select("inst_id", "ts_us", F.col("max_px_diff").alias(f"max_px_diff_{name}"), F.col("max_sz_diff").alias(f"max_sz_diff_{name}")))
    return reduce(lambda x, y: x.join(y, ["inst_id", "ts_us"]), parts)


def ordering_audit(messages: DataFrame, by: tuple[str, ...] = ("inst_id",), time_col: str = "ts_us") -> DataFrame:
    per = messages.groupBy(*by, time_col).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(
        F.count("*").alias("times"), F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("duplicated_times"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_in_duplicates"), F.max("n").alias("most_at_one_time"),
    )


def duplicated_times(messages: DataFrame, ingest: str, k: int = 30, by: tuple[str, ...] = ("inst_id",), time_col: str = "ts_us") -> DataFrame:
    per = messages.groupBy(*by, time_col).agg(F.count("*").alias("n"), F.min(ingest).alias("first_ingest"), F.max(ingest).alias("last_ingest"), F.countDistinct(ingest).alias("n_ingest"))
    return per.where("n > 1").orderBy(F.desc("n"), *by, time_col).limit(k)
