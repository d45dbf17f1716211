"""Small literal cases: nulls, ties, empty sides, errors, leaks, plans and the streaming forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import names, rowwise
from tickloom.functions.timewin import SECOND, asof, past_start, prefix_sums, with_rn
from tickloom.operators import assemble, book, evaluate, labels, passage, stats
from tickloom.schema import nan_to_null, prepare
from tickloom.sources import deltas, tables


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def wide(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    mid = 100 + np.cumsum(rng.integers(-3, 4, n)) * 0.1
    cols = {"inst_id": ["A"] * n, "event_id": range(n), "ts_us": np.cumsum(rng.integers(0, 3, n)) * SECOND // 2, "mid_px": mid, "spread_px": 0.2}
    for i in range(1, 11):
        cols |= {f"bid_px_{i:02d}": mid - 0.1 * i, f"ask_px_{i:02d}": mid + 0.1 * i, f"bid_sz_{i:02d}": rng.integers(1, 9, n) * 1.0, f"ask_sz_{i:02d}": rng.integers(1, 9, n) * 1.0}
    return spark.createDataFrame(pd.DataFrame(cols))


def test_imbalance_and_spread(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 3.0), (0.0, 0.0)], "bid_sz_01 double, ask_sz_01 double")
    assert values(df, rowwise.imbalance(1)) == [(0.5,), (-0.5,), (None,)]
    with pytest.raises(ValueError, match="ask_sz_01"):
        rowwise.with_imbalance(df.drop("ask_sz_01"), 1)
    df = spark.createDataFrame([(100.0, 100.2)], "bid_px_01 double, ask_px_01 double")
    assert values(df, rowwise.relative_spread())[0][0] == pytest.approx(0.002, abs=1e-5)
    with pytest.raises(ValueError, match="ask_px_01"):
        rowwise.with_spread(df.drop("ask_px_01"))


def test_missing_levels_skip_or_propagate(spark):
    schema = ", ".join(f"{s}_sz_{i:02d} double" for s in ("bid", "ask") for i in (1, 2, 3))
    df = spark.createDataFrame([(2.0, None, 2.0, 1.0, 1.0, 0.0)], schema)
    assert values(df, rowwise.imbalance(3), rowwise.imbalance(3, skip_null=False)) == [((4 - 2) / 6, None)]


def test_future_move_and_metrics(spark):
    df = spark.createDataFrame([("A", i, i, m) for i, m in enumerate([100.0, 100.0, 101.0, 99.0, 99.0])], "inst_id string, ts_us long, event_id long, mid_px double")
    from tickloom.functions.timewin import ordered

    out = df.withColumn("y", labels.future_move("mid_px", 2, 0.001, ordered())).orderBy("event_id")
    assert [r.y for r in out.collect()] == [1, -1, -1, 0, 0]
    m = {k: c.alias(k) for k, c in evaluate.signal_metrics("p", "y").items()}
    r = spark.createDataFrame([(0, 1), (0, -1)], "p int, y int").agg(*m.values()).first()
    assert r.hit_rate == r.precision_long == r.precision_short == 0.0


def test_deltas_parse_both_shapes(spark):
    texts = ['[["100.1","2"]]', '[["100.0","0","0","1"]]', '[{"price":"99","size":"1.5"}]', "", None, '[["x","1"],["3"]]', "{}", "no json"]
    df = spark.createDataFrame([("A", 1, i, t, None) for i, t in enumerate(texts)], "inst_id string, ts_us long, msg_seq long, bids_delta string, asks_delta string")
    assert sorted(values(deltas.explode_deltas(df), "msg_seq", "side", "price", "size")) == [(0, "bid", 100.1, 2.0), (1, "bid", 100.0, 0.0), (2, "bid", 99.0, 1.5)]


def replay(changes, times):
    """State after all changes at or before each time, by a plain loop."""
    out = {}
    for t in times:
        held = {}
        for ts, _, side, price, size in sorted(c for c in changes if c[0] <= t):
            held.pop((side, price), None)
            if size > 0:
                held[side, price] = size
        out[t] = held
    return out


def test_replay_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    changes = [(int(rng.integers(0, 200)), i, rng.choice(["bid", "ask"]), float(rng.integers(90, 110)), float(rng.integers(0, 4))) for i in range(400)]
    changes = [(a, b, str(c), d, e) for a, b, c, d, e in changes]
    df = spark.createDataFrame([("A", 0, *c) for c in changes], "inst_id string, seg_us long, ts_us long, seq long, side string, price double, size double")
    emits = spark.createDataFrame([("A", 0, t) for t in range(0, 210, 7)], "inst_id string, seg_us long, ts_us long")
    got = {}
    for r in book.states(book.validity(df), emits, 50, bucket_us=20).collect():
        got.setdefault(r.ts_us, {})[r.side, r.price] = r["size"]
    assert got == {t: s for t, s in replay(changes, range(0, 210, 7)).items() if s}
    with pytest.raises(Exception, match="unknown side"):
        book.check_sides(df.withColumn("side", F.lit("up"))).collect()


def test_empty_side_and_wide_round_trip(spark):
    df = spark.createDataFrame([("A", 1, "bid", 1, 99.0, 2.0)], "inst_id string, ts_us long, side string, level int, price double, size double")
    out = book.levels_to_wide(df, ("inst_id", "ts_us"), 2)
    assert values(out, "bid_px_01", "ask_px_01", "mid_px", "bid_px_02") == [(99.0, None, None, None)]
    assert values(book.wide_to_levels(out, depth=2), "side", "level", "price", "size") == [("bid", 1, 99.0, 2.0)]


def test_asof_matches_searchsorted_with_ties(spark):
    rng = np.random.default_rng(2)
    ts = np.sort(rng.integers(0, 300, 200))
    df = with_rn(spark.createDataFrame(pd.DataFrame({"inst_id": "A", "event_id": range(200), "ts_us": ts * SECOND})))
    for reach in (None, 10 * SECOND):
        back = asof(df, df, F.col("ts_us"), F.col("ts_us"), F.col("event_id"), reach=reach).toPandas().sort_values("event_id")
        assert (back["found"].to_numpy() == np.searchsorted(ts, ts, "right") - 1).all()
    start = past_start(df, 10, F.col("event_id")).toPandas().sort_values("event_id")["start"]
    want = [np.searchsorted(ts, t - 10, "left") if t - 10 >= ts[0] else None for t in ts]
    assert [None if pd.isna(x) else int(x) for x in start] == want
    sums = prefix_sums(df, ["event_id"], bucket=7 * SECOND).toPandas().sort_values("event_id")
    assert (sums["cum_event_id"].to_numpy() == np.cumsum(range(200))).all()


def test_first_passage_equals_a_scan(spark):
    rng = np.random.default_rng(4)
    n, mid, ts = 300, 100 + np.cumsum(rng.integers(-2, 3, 300)), np.cumsum(rng.integers(0, 3, 300))
    df = spark.createDataFrame(pd.DataFrame({"inst_id": "A", "event_id": range(n), "ts_us": ts * SECOND, "mid_px": mid * 1.0}))
    got = passage.first_passage(df, 30, 1.0, (3,), bucket_s=40).toPandas().sort_values("event_id")
    for i in range(n):
        for name, sign in (("up_3", 1), ("down_3", -1)):
            hits = [ts[j] - ts[i] for j in range(i + 1, n) if ts[j] <= ts[i] + 30 and sign * (mid[j] - mid[i]) >= 3]
            x = got[name].iloc[i]
            assert (None if pd.isna(x) else int(x)) == (int(hits[0]) * SECOND if hits else None)


def test_features_do_not_look_ahead(spark):
    df = wide(spark, 80)
    cut = df.where("event_id < 60")
    for build in (lambda x: assemble.baseline_features(x, 0.1, 100, (300, 100)), lambda x: assemble.wallclock_features(x, 0.1, (1, 5)).drop("volatility_regime", "spread_regime", "activity_regime")):
        whole, part = (build(x).where("event_id < 60").toPandas().sort_values("event_id").reset_index(drop=True) for x in (df, cut))
        pd.testing.assert_frame_equal(whole, part, rtol=1e-9)


def test_one_step_volatility_is_null(spark):
    out = assemble.baseline_features(wide(spark, 20), 0.1, 100, (100,))
    assert out.where("mid_vol_h100 is not null").count() == 0


def test_single_and_no_rows(spark):
    one = wide(spark, 1)
    assert assemble.wallclock_features(one, 0.1, (1, 5)).count() == 1
    assert labels.grid_regularity(one, 100).first().regular is False
    none = one.where("false")
    assert assemble.wallclock_features(none, 0.1, (1, 5)).count() == 0
    assert passage.first_passage(none, 30, 1.0, (3,)).count() == 0
    assert assemble.modeling_dataset(none).count() == 0


def test_nan_and_coercion(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert values(nan_to_null(df), "x") == [(None,), (2.0,)]
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "1.5", "0.1"), ("bad", "1", "1"), ("2024-01-01 00:00:01", "x", "1")], "ts_event string, mid_px string, spread_px string")
    assert values(prepare(raw), "mid_px") == [(1.5,)]


def test_occurrence_join_pairs_multisets(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (1, "r"), (1, "s")], "k int, y string")
    assert sorted(values(stats.occurrence_join(a, b, ["k"], ["x"], ["y"]), "x", "y")) == [("a", "p"), ("b", "r"), ("c", "q")]


def test_names_and_windows():
    assert names.windows_of("5, 1,3") == [1, 3, 5]
    for bad in ("", "1,1", "0", "x"):
        with pytest.raises(ValueError):
            names.windows_of(bad)
    with pytest.raises(ValueError):
        tables.check_identifier("a; drop")


def test_book_files_prune(spark, tmp_path):
    df = wide(spark, 10).withColumn("reconstruction_mode", F.lit("event"))
    tables.write_book(df, str(tmp_path / "b"))
    back = tables.read_book(spark, str(tmp_path / "b"), "A", 0, 10**12, "event")
    assert back.count() == 10
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()


def test_plans_have_no_nested_loops(spark):
    rows = spark.range(10).selectExpr("cast(id % 2 as string) as inst_id", "id % 3 as seg_us", "id as ts_us", "id as seq", "'bid' as side", "cast(id as double) as price", "1e0 as size")
    plan = book.states(book.validity(rows), book.event_emits(rows), 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_gbt_learns(spark):
    df = spark.range(200).selectExpr("cast(id % 2 as double) as y", "cast(id % 2 as double) + rand(1) * 0.1 as x", "if(id % 9 = 0, null, 1e0) as z", "id % 5 = 0 as validation")
    model = evaluate.train_gbt(df, ["x", "z"], "y", rounds=3, depth=2)
    assert model.transform(df).where("prediction = y").count() == 200


def test_streams_equal_batches(spark, tmp_path):
    from tickloom.streaming.book import book_top, minute_profile

    rows = [("A", 1, 1, "bid", 99.0, 2.0), ("A", 1, 2, "ask", 101.0, 1.0), ("A", 2, 3, "bid", 99.0, 0.0), ("A", 3, 4, "bid", 98.0, 5.0)]
    schema = "inst_id string, ts_us long, seq long, side string, price double, size double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "d"))
    q = book_top(spark.readStream.schema(schema).parquet(str(tmp_path / "d"))).writeStream.format("memory").queryName("tops").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tops").collect())) == [("A", 1, 99.0, 2.0, 101.0, 1.0), ("A", 2, None, None, 101.0, 1.0), ("A", 3, 98.0, 5.0, 101.0, 1.0)]
    batch = spark.createDataFrame([("A", 1.0), ("A", 3.0)], "inst_id string, v double").withColumn("ts_event", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    r = minute_profile(batch, "v").first()
    assert (r.n, r["mean"]) == (2, 2.0)
