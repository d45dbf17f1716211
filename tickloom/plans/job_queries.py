"""Queries of jobs and of what is built from declared columns: shards written and read again, a resumed reconstruction, targets by name, exits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..cuts import cut, drop_path, shared_path
from ..functions import names, ranged, roles
from ..functions.timewin import SECOND
from ..operators import assemble, book as B, passage, stability
from ..operators.replay import carried_replay
from ..sources import deltas, shards, tables
from . import views as V
from .more_queries import _END, _EVENTS, _OPEN, _REBUILD, _START, _opening, _targets_sql
from .queries import query
from .views import DAY, TICK

HOUR = 3600


@query(f"SELECT inst_id, event_id, ts_us, mid_px FROM book WHERE ts_us BETWEEN {_START} AND {_END}", "book")
def shard_range(spark, d):
    """The book written as daily shards, then a range of it read by the data source, instrument by instrument."""
    root = shared_path(spark, "shards")
    rows = V.book(spark, d).select("inst_id", F.timestamp_micros("ts_us").alias("ts_event"), "event_id", "mid_px")
    instruments = [r.inst_id for r in shards.write_shards(rows, root, "grid100ms", 24).select(F.element_at(F.split("path", "/"), -4).alias("inst_id")).distinct().collect()]
    parts = [shards.read_shards_of(spark, root, i, _START, _END, "grid100ms") for i in sorted(instruments)]
    found = cut(reduce(lambda x, y: x.unionByName(y), parts).select("inst_id", "event_id", F.unix_micros("ts_event").alias("ts_us"), "mid_px"), "range")
    drop_path(spark, root)
    return found


_RANGES = [(_START, _START + 2 * DAY), (_START + 2 * DAY, _END)]
_CHUNK = "SELECT inst_id, anchor_snapshot_us, ts_us, (bid_px_01 + ask_px_01) / 2 AS mid_px, bid_sz_01, ask_px_10 FROM rec"


def _chunk_sql(a: int, z: int) -> str:
    part = f"(WITH {_OPEN}, {_EVENTS}, {_REBUILD} {_CHUNK})"
    return f"SELECT '{a}-{z}' AS chunk, * FROM {part.replace(str(_START), str(a)).replace(str(_END), str(z))}"


@query(" UNION ALL ".join(_chunk_sql(a, z) for a, z in _RANGES), "deltas")
def resumed_reconstruction(spark, d):
    """Two chunks; the job is run for the first one, then for both, so the second run goes on where the first one stopped."""
    root, rows = shared_path(spark, "chunks"), V.deltas(spark, d)
    opening = _opening(rows)
    B.reconstruct_job(opening, rows, root, _RANGES[:1])
    B.reconstruct_job(opening, rows, root, _RANGES)
    kept = spark.read.parquet(root).select("chunk", F.col("inst_id").cast("string").alias("inst_id"), "anchor_snapshot_us", "ts_us", "mid_px", "bid_sz_01", "ask_px_10")
    found = cut(kept, "resumed")
    drop_path(spark, root)
    return found


def _snapshot_anchor(a: int, z: int) -> str:
    return f"""SELECT {a}::BIGINT AS start_us, {z}::BIGINT AS end_us, s.inst_id, max(ts_us) FILTER (ts_us <= {a}) AS anchor_us, any_value(coalesce(n, 0))::BIGINT AS n_deltas,
      CASE WHEN max(ts_us) FILTER (ts_us <= {a}) IS NULL THEN 'no anchor' WHEN any_value(coalesce(n, 0)) = 0 THEN 'no deltas' ELSE 'written' END AS status
      FROM s LEFT JOIN (SELECT inst_id, count(*) AS n FROM deltas WHERE ts_us BETWEEN {a} AND {z} GROUP BY inst_id) o ON s.inst_id = o.inst_id WHERE ts_us <= {z} GROUP BY s.inst_id"""


_EARLY = [(1704067200 * SECOND - DAY, 1704067200 * SECOND + DAY // 8), *_RANGES]


@query(f"WITH s AS (SELECT DISTINCT inst_id, ts_us // {DAY} * {DAY} AS ts_us FROM deltas) " + " UNION ALL ".join(f"({_snapshot_anchor(a, z)})" for a, z in _EARLY), "deltas")
def reconstruction_manifest(spark, d):
    """What the job reports of each chunk and instrument; the first chunk begins before the first snapshot."""
    root, rows = shared_path(spark, "chunks"), V.deltas(spark, d)
    found = cut(B.reconstruct_job(_opening(rows), rows, root, _EARLY, depth=2).select("start_us", "end_us", "inst_id", "anchor_us", "n_deltas", "status"), "manifest")
    drop_path(spark, root)
    return found


_PART = "'^(long|short)_hit_(?:up|down)_([0-9]+)t(?:_before_(?:up|down)(?:_([0-9]+)t)?)?_within_([0-9]+)s$'"


@query(
    f"""WITH t AS ({_targets_sql()}), u AS (UNPIVOT (SELECT * EXCLUDE event_id FROM t) ON COLUMNS(*) INTO NAME name VALUE v), s AS (SELECT name, sum(v)::DOUBLE AS total, count(*) AS n FROM u GROUP BY name),
    k AS (SELECT *, try_cast(nullif(regexp_extract(name, {_PART}, 2), '') AS INT) AS threshold_ticks, try_cast(nullif(regexp_extract(name, {_PART}, 3), '') AS INT) AS paired, name LIKE '%excursion%' AS ex, regexp_matches(name, '_before_(up|down)_within') AS sym FROM s)
    SELECT name, n, round(total, 2) AS total, CASE WHEN ex THEN 'regression' ELSE 'binary' END AS kind, split_part(name, '_', 1) AS direction, threshold_ticks, CASE WHEN sym THEN threshold_ticks ELSE paired END AS adverse_ticks,
      try_cast(regexp_extract(name, 'within_([0-9]+)s$', 1) AS INT) AS horizon_sec, threshold_ticks = CASE WHEN sym THEN threshold_ticks ELSE paired END AS symmetric, CASE WHEN ex THEN split_part(name, '_', 3) END AS excursion_type,
      coalesce(threshold_ticks >= 450, false) AS eligible FROM k""",
    "ticks",
)
def target_columns(spark, d):
    """Every target column of the built table with the fields of its name, its number of values and their sum."""
    built = passage.targets_dataset(V.ticks(spark, d), TICK, (HOUR, 3 * HOUR), (300, 600), passage.half_pairs((300, 600)), step_rows=3)
    rows = roles.declared_columns(built).where("role = 'target'").select(F.col("column").alias("name"), "n", F.round("total", 2).alias("total"))
    return rows.withColumns(names.target_fields(F.col("name")) | {"eligible": names.modeling_eligible(F.col("name"), 450)})


_LOOK_AHEAD = {h: -(-h // 100) for h in (500, 1000)}


@query(
    "WITH f AS (SELECT *, "
    + ", ".join(f"lead({c}, {k}) OVER w AS f{h}_{c}" for h, k in _LOOK_AHEAD.items() for c in ("mid_px", "bid_px_01", "ask_px_01"))
    + " FROM book WINDOW w AS (PARTITION BY inst_id ORDER BY ts_us, event_id)), k AS (SELECT * FROM f WHERE "
    + " AND ".join(f"f{h}_{c} IS NOT NULL AND {c} IS NOT NULL" for h in _LOOK_AHEAD for c in ("mid_px", "bid_px_01", "ask_px_01"))
    + "), x AS (SELECT "
    + ", ".join(
        f"greatest(coalesce((f{h}_ask_px_01 - bid_px_01) / 0.1::DOUBLE - (bid_px_01 * 0.0002::DOUBLE + f{h}_ask_px_01 * 0.0007::DOUBLE) / 0.1::DOUBLE >= 0, false)::INT, "
        f"coalesce((ask_px_01 - f{h}_bid_px_01) / 0.1::DOUBLE - (ask_px_01 * 0.0002::DOUBLE + f{h}_bid_px_01 * 0.0007::DOUBLE) / 0.1::DOUBLE >= 0, false)::INT) AS y{h}"
        for h in _LOOK_AHEAD
    )
    + " FROM k) "
    + " UNION ALL ".join(f"SELECT {h} AS horizon_ms, 'net_profitable_any_h{h}' AS target, count(*) AS n, sum(y{h})::BIGINT AS positives, 0 AS n_leaks FROM x" for h in _LOOK_AHEAD),
    "book",
)
def chosen_targets(spark, d):
    """The target that each horizon's choice takes on the modelling table, how often it is 1, and how many columns that look ahead the features hold."""
    table = assemble.modeling_dataset(V.book(spark, d), assemble.ModelingConfig(horizons_ms=tuple(_LOOK_AHEAD), lookbacks_ms=(100,), holding_ms=(200,)))
    picked = {h: roles.choose_target(table, h) for h in _LOOK_AHEAD}
    leaks = {h: sum(roles.target_of(c) is not None for c in roles.model_features(table, y)[0]) for h, y in picked.items()}
    sums = table.agg(F.count("*").alias("n"), *(F.sum(y).alias(f"y{h}") for h, y in picked.items()))
    rows = [F.struct(F.lit(h).alias("horizon_ms"), F.lit(y).alias("target"), F.col("n"), F.col(f"y{h}").alias("positives"), F.lit(leaks[h]).alias("n_leaks")) for h, y in picked.items()]
    return sums.select(F.inline(F.array(*rows)))


def _exit_sql(side: str, take: int, stop: int, rows: int) -> str:
    gain = "(b.mid_px - a.bid_px_01)" if side == "long" else "(a.ask_px_01 - b.mid_px)"
    hit = lambda test: f"min(b.n - a.n) FILTER (b.n - a.n <= {rows} AND {gain} / 0.01::DOUBLE {test})"
    tp, sl = hit(f">= {take}"), hit(f"<= -{stop}")
    return f"CASE WHEN {tp} IS NOT NULL AND ({sl} IS NULL OR {tp} < {sl}) THEN 1 WHEN {sl} IS NOT NULL THEN -1 ELSE 0 END AS tp_sl_{side}_tp{take}_sl{stop}_r{rows}"


_EXITS = [(side, a, b, rows) for rows in (10, 150) for side in ("long", "short") for a in (500, 3000) for b in (700, 5000)]


@query(
    f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY ts_us, event_id) AS n FROM book) SELECT a.event_id, {', '.join(_exit_sql(*e) for e in _EXITS)} "
    "FROM n a LEFT JOIN n b ON a.inst_id = b.inst_id AND b.n > a.n AND b.n <= a.n + 150 GROUP BY a.event_id",
    "book",
)
def entry_price_exits(spark, d):
    """Sixteen exits of up to 150 rows by one first passage from each row's own entry price."""
    rows = V.book(spark, d).select("inst_id", "event_id", "ts_us", "mid_px", "bid_px_01", "ask_px_01")
    return passage.entry_exits(rows, TICK, (500, 3000), (700, 5000), {"r10": 10, "r150": 150}).drop("inst_id", "ts_us", "mid_px", "bid_px_01", "ask_px_01")


_NEAR = """WITH f AS (SELECT unnest([{'feature': 'score', 'x': score}, {'feature': 'root', 'x': sqrt(doc_id::DOUBLE)}]) AS f, y FROM scores WHERE y IS NOT NULL),
  l AS (SELECT f.feature AS feature, f.x AS x, y, row_number() OVER () AS id, count(*) OVER (PARTITION BY f.feature, y) AS c FROM f WHERE f.x IS NOT NULL),
  k AS (SELECT * FROM l WHERE c > 1),
  e AS (SELECT feature, id, x, c, least(3, c - 1) AS used, list_sort(list_filter([{'d': abs(v - x), 'v': v} for v in [lag(x, 1) OVER w, lag(x, 2) OVER w, lag(x, 3) OVER w, lead(x, 1) OVER w, lead(x, 2) OVER w, lead(x, 3) OVER w]], lambda s: s.v IS NOT NULL)) AS ds
        FROM k WINDOW w AS (PARTITION BY feature, y ORDER BY x, id)),
  r AS (SELECT feature, id, x, c, used, ds[used].d AS r, ds[used].v AS v FROM e),
  b AS (SELECT *, CASE WHEN r = 0 THEN x WHEN v < x THEN v ELSE x - r END AS lo, CASE WHEN r = 0 THEN x WHEN v > x THEN v ELSE x + r END AS hi FROM r),
  m AS (SELECT b.feature, b.id, any_value(b.c) AS c, any_value(b.used) AS used, count(*) AS m FROM b JOIN b o ON o.feature = b.feature AND ((b.r = 0 AND o.x = b.x) OR (b.r > 0 AND o.x > b.lo AND o.x < b.hi)) GROUP BY b.feature, b.id),
  h AS (SELECT i, -0.5772156649015329::DOUBLE + sum(CASE WHEN i > 1 THEN 1.0::DOUBLE / (i - 1) ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS psi FROM (SELECT range AS i FROM range(1, (SELECT count(*) + 2 FROM scores)))),
  s AS (SELECT feature, count(*) AS n, avg(hk.psi) - avg(hc.psi) - avg(hm.psi) AS rest FROM m JOIN h hk ON hk.i = m.used JOIN h hc ON hc.i = m.c JOIN h hm ON hm.i = m.m GROUP BY feature)
  SELECT feature, n, round(greatest(0, psi + rest), 6) AS mutual_info FROM s JOIN h ON h.i = s.n"""


@query(_NEAR, "scores")
def nearest_information(spark, d):
    """Mutual information with the label by nearest neighbours: a score with many ties and a feature without any."""
    rows = V.scores(spark, d).withColumn("root", F.sqrt(F.col("doc_id").cast("double")))
    return ranged.nearest_information(rows, ["score", "root"], "y").select("feature", "n", F.round("mutual_info", 6).alias("mutual_info"))


@query(
    """WITH p AS (SELECT (mid_px > 60)::INT AS y, event_id % 97 AS s, least((row_number() OVER (ORDER BY ts_us, event_id) - 1) * 3 // count(*) OVER (), 2)::INT AS part FROM ticks),
    r AS (SELECT part, y, s, rank() OVER (PARTITION BY part ORDER BY s) + (count(*) OVER (PARTITION BY part, s) - 1) / 2e0 AS r FROM p),
    a AS (SELECT part, count(*) AS n, avg(y) AS positive_rate, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY part),
    g AS (SELECT part, s, sum(y) AS pos, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT part, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS ab FROM g WINDOW w AS (PARTITION BY part ORDER BY s DESC)),
    q AS (SELECT part, sum(pos * (tp / ab::DOUBLE)) / sum(pos) AS ap FROM h GROUP BY part)
    SELECT part, n, round(positive_rate, 9) AS positive_rate, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision FROM a JOIN q USING (part)""",
    "ticks",
)
def stability_of_score(spark, d):
    """Area under the curve and average precision of a score in thirds of the rows by time."""
    rows = V.ticks(spark, d).selectExpr("ts_us", "event_id", "CAST(mid_px > 60 AS INT) AS y", "CAST(event_id % 97 AS DOUBLE) AS s")
    found = stability.stability_of_score(rows, "y", "s", ["ts_us", "event_id"])
    return found.select("part", "n", *(F.round(c, 9).alias(c) for c in ("positive_rate", "roc_auc", "average_precision")))


def _ordered_book(name: str, seq: str) -> str:
    return f"""{name}_live AS (SELECT e.inst_id, e.ts_us, c.side, c.price, arg_max(c.size, (c.ts_us, {seq})) AS size FROM s e JOIN x c ON c.inst_id = e.inst_id AND c.ts_us <= e.ts_us GROUP BY ALL),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inst_id, ts_us, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM {name}_live WHERE size > 0) WHERE level <= 10)"""


@query(
    f"""WITH x AS (SELECT inst_id, ts_us // {2 * DAY} * {2 * DAY} AS ts_us, seq, side, price, size FROM deltas), t AS (SELECT DISTINCT inst_id, ts_us FROM x),
    s AS (SELECT * FROM t WHERE ('0x' || substr(md5('42#' || inst_id || '#' || ts_us), 1, 8))::BIGINT < {int(0.5 * (1 << 32))}), {_ordered_book('good', 'c.seq')}, {_ordered_book('bad', '-c.seq')},
    f AS (SELECT inst_id, ts_us, max(abs(g.price - b.price)) AS px, max(abs(g.size - b.size)) AS sz FROM good g FULL JOIN bad b USING (inst_id, ts_us, side, level) GROUP BY ALL),
    w AS (SELECT * FROM f ORDER BY px DESC NULLS LAST, sz DESC NULLS LAST, inst_id, ts_us LIMIT 12)
    SELECT inst_id, ts_us, round(px, 9) AS max_px_diff_back, sz AS max_sz_diff_back, 0e0 AS max_px_diff_fixed, 0e0 AS max_sz_diff_fixed, coalesce(px > 0 OR sz > 0, false) AS improved FROM w""",
    "deltas",
)
def sampled_forensics(spark, d):
    """Half of the times of two days each: the twelve that differ most from the book if changes of a time are played backwards, and what the right order mends."""
    rows = V.deltas(spark, d).withColumn("ts_us", F.floor(F.col("ts_us") / (2 * DAY)) * (2 * DAY)).withColumn("back", -F.col("seq"))
    times = rows.select("inst_id", "ts_us").distinct().withColumn("seg_us", F.lit(0))
    real = B.wide_to_levels(carried_replay(rows.withColumn("seg_us", F.lit(0)), times))
    found = B.sampled_forensics(real, rows, 12, {"back": ("back",), "fixed": ("seq",)}, share=0.5)
    return found.withColumn("max_px_diff_back", F.round("max_px_diff_back", 9))


_IMBALANCE_5 = (lambda b, a: f"(({b}) - ({a})) / nullif(({b}) + ({a}), 0)")(*(" + ".join(f"{side}_sz_{i:02d}" for i in range(1, 6)) for side in ("bid", "ask")))
_ONE_SECOND = ("mid_velocity_1s", "mid_acceleration_1s", "imbalance_5_delta_1s", "imbalance_5_acceleration_1s", "spread_ticks", "spread_over_mid", "seconds_since_large_move")


@query(
    f"""WITH r AS (SELECT inst_id, event_id, ts_us // {HOUR} AS t, mid_px, spread_px, {_IMBALANCE_5} AS i5, row_number() OVER (PARTITION BY inst_id ORDER BY ts_us // {HOUR}, event_id) AS rn FROM book),
    x AS (SELECT *, min(rn) OVER (PARTITION BY inst_id ORDER BY t RANGE BETWEEN {SECOND} PRECEDING AND CURRENT ROW) AS s_rn, t - {SECOND} >= min(t) OVER (PARTITION BY inst_id) AS ok FROM r),
    f AS (SELECT x.*, (x.mid_px - b.mid_px) / 0.01::DOUBLE AS move, ((x.mid_px - b.mid_px) / 0.01::DOUBLE) / nullif((x.t - b.t) / 1e6, 0) AS v, x.i5 - b.i5 AS d FROM x LEFT JOIN r b ON b.inst_id = x.inst_id AND x.ok AND b.rn = x.s_rn),
    g AS (SELECT f.*, (f.v - p.v) / nullif((f.t - p.t) / 1e6, 0) AS a, (f.d - p.d) / nullif((f.t - p.t) / 1e6, 0) AS da FROM f LEFT JOIN f p ON p.inst_id = f.inst_id AND f.ok AND p.rn = f.s_rn),
    h AS (SELECT *, (t - max(CASE WHEN abs(move) > 500 THEN t END) OVER (PARTITION BY inst_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)) / 1e6 AS since FROM g)
    SELECT inst_id, count(*) AS n, round(sum(v), 2) AS mid_velocity_1s, round(sum(a), 2) AS mid_acceleration_1s, round(sum(d), 2) AS imbalance_5_delta_1s, round(sum(da), 2) AS imbalance_5_acceleration_1s,
      round(sum(spread_px / 0.01::DOUBLE), 2) AS spread_ticks, round(sum(spread_px / nullif(mid_px, 0)), 2) AS spread_over_mid, round(sum(since), 2) AS seconds_since_large_move FROM h GROUP BY inst_id""",
    "book",
)
def wallclock_one_second(spark, d):
    """The one-second columns of the wall-clock builder, over the book with an hour's time in a second: velocity, both accelerations, time since a large move."""
    rows = V.book(spark, d).withColumn("ts_us", F.floor(F.col("ts_us") / HOUR))
    built = assemble.wallclock_features(rows, TICK, (1,), large_move_ticks=500.0)
    return built.groupBy("inst_id").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 2).alias(c) for c in _ONE_SECOND))


@query(
    "WITH d AS (SELECT inst_id, ts_us, seq, CASE WHEN seq % 4 = 0 THEN upper(side) WHEN seq % 4 = 1 THEN CASE side WHEN 'bid' THEN '1' ELSE '2' END ELSE side END AS raw, price, size FROM deltas), "
    "s AS (SELECT *, CASE lower(raw) WHEN 'bid' THEN 'bid' WHEN '1' THEN 'bid' WHEN 'ask' THEN 'ask' WHEN '2' THEN 'ask' END AS side FROM d) SELECT inst_id, side, count(*) AS n, round(sum(price), 6) AS price_sum FROM s GROUP BY ALL",
    "deltas",
)
def normalised_sides(spark, d):
    """Sides given as text in either case or as numbers, brought to bid and ask."""
    rows = V.deltas(spark, d)
    raw = F.when(F.col("seq") % 4 == 0, F.upper("side")).when(F.col("seq") % 4 == 1, F.when(F.col("side") == "bid", "1").otherwise("2")).otherwise(F.col("side"))
    named = rows.withColumn("side", deltas.side_name(raw))
    return named.groupBy("inst_id", "side").agg(F.count("*").alias("n"), F.round(F.sum("price"), 6).alias("price_sum"))


@query(
    f"SELECT inst_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM book WHERE ts_us >= {_START} AND ts_us < {_START + 3 * DAY} AND inst_id = 'click' GROUP BY inst_id",
    "book",
)
def half_open_scan(spark, d):
    """An instrument's rows in [start, end): the scan by days."""
    found = tables.scan(V.book(spark, d), "click", _START, _START + 3 * DAY, "ts_us", ["inst_id", "ts_us"], closed=False)
    return tables.presence(found)


@query(
    f"SELECT inst_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM (SELECT DISTINCT inst_id, ts_us // {DAY} * {DAY} AS ts_us FROM deltas) WHERE ts_us > {1704067200 * SECOND + 2 * DAY} AND ts_us <= {1704067200 * SECOND + 9 * DAY} GROUP BY inst_id",
    "deltas",
)
def snapshot_times_between(spark, d):
    """Snapshot times in (start, end]."""
    begin = 1704067200 * SECOND + 2 * DAY
    return tables.presence(tables.snapshot_times(_opening(V.deltas(spark, d)), begin, begin + 7 * DAY))
