"""Jobs and helpers that are no queries: shards, exact snapshots, reports, feature choice, boosters, experiments."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import names, roles
from tickloom.functions.timewin import value_sums, with_average_rank_pct
from tickloom.operators import book as B
from tickloom.operators import eda, evaluate, labels, passage
from tickloom.schema import book_columns
from tickloom.sources import tables

SECOND = 1_000_000


def test_hourly_shards(spark, tmp_path):
    base = 1774224000 * SECOND  # 2026-03-23
    name = "book_grid100ms_X-1_2026-03-23_0{}-00-00__2026-03-23_0{}-00-00.parquet"
    for h in range(3):  # each shard holds both its ends
        df = spark.createDataFrame([("X-1", base + (h * 3600 + s) * SECOND) for s in (0, 1800, 3600)], "inst_id string, ts_us long")
        df.write.parquet(str(tmp_path / name.format(h, h + 1)))
    got = tables.read_shards(spark, str(tmp_path), "X-1", base + 1800 * SECOND, base + 7200 * SECOND)
    assert sorted((r.ts_us - base) // SECOND for r in got.collect()) == [1800, 3600, 5400, 7200]
    assert tables.overlapping_bounds(spark.read.parquet(str(tmp_path / name.format(0, 1))), base, base).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_shards(spark, str(tmp_path), "Y", base, base)


def test_snapshot_sources(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("b", 3, 1)], "inst_id string, ts_us long, level int")
    assert tables.snapshot_at(df, "a", 1).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.snapshot_at(df, "a", 9)
    assert tables.anchor_rows(df, F.lit(2)).count() == 2 and tables.anchor_rows(df, F.lit(2), strict=False).count() == 1
    assert tables.renamed_time(df, "ts_us").columns[1] == "ts_event" and tables.renamed_time(df.withColumnRenamed("ts_us", "ts_event"), "ts_event").columns[1] == "ts_event"
    with pytest.raises(ValueError, match="missing"):
        tables.snapshot_scan(df, "a")
    wide = df.select("inst_id", F.timestamp_micros("ts_us").alias("ts_event"), *(F.lit(1.0).alias(c) for c in book_columns()))
    tables.export_sample(wide, "a", str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3
    monkeypatch.setenv("PGUSER", "me")
    assert tables.postgres_url("h", 1, "d") == ("jdbc:postgresql://h:1/d", {"user": "me"})
    assert tables.markdown_table(df.where("inst_id = 'b'")) == "| inst_id | ts_us | level |\n| - | - | - |\n| b | 3 | 1 |"


def test_names_and_feature_choice(spark):
    assert names.int_list("3, 1,") == [3, 1] and names.is_long_horizon("mid_return_300s") and not names.is_long_horizon("mid_return_30s")
    features = ["mid_px", "mid_return_5s", "mid_return_300s", "mid_return_3600s", "spread_regime"]
    assert roles.group_features(features, "SHORT_ONLY") == ["mid_return_5s"]
    assert roles.group_features(features, "SHORT_PLUS_3600") == ["mid_return_3600s", "mid_return_5s"]
    assert roles.group_features(features, "ALL_WITHOUT_PRICE") == features[1:] and roles.group_features(features, "ALL_FEATURES") == features
    assert roles.group_features(["activity_regime", "update_regime", "x"], "SHORT_ONLY") == ["x"]
    with pytest.raises(ValueError):
        roles.group_features(features, "Z")
    df = spark.createDataFrame([("a", 1.0, 1, 0, "s", 1)], "inst_id string, x double, target_y int, target_z int, word string, target_gross_profitable_h500 int")
    assert roles.choose_target(df.withColumn("target_mid_dir_h500", F.lit(1)), 500) == "target_gross_profitable_h500"
    for bad in ((df, 600), (df, 500, ["no"])):
        with pytest.raises(ValueError):
            roles.choose_target(*bad)
    used, why = roles.model_features(df, "target_y")  # a table that declares nothing
    assert used == ["x"] and why == {"inst_id": "is an identifier", "target_y": "is the target", "target_z": "is a target", "word": "is of type string", "target_gross_profitable_h500": "is a target"}
    assert set(names.feature_groups([5])) == {"price", "depth", "imbalance", "order_flow", "regime"}


def test_builder_has_all_grouped_names(spark):
    from tickloom.operators.assemble import wallclock_features
    from tickloom.plans import views

    rows = wallclock_features(views.book(spark, "/root/testdata/sf0.001"), 0.01, (1,))
    assert [c for g in names.feature_groups([1]).values() for c in g if c not in rows.columns] == []


def test_auto_alignment(spark):
    rows = [("grid", i, i * 100_000, float(i)) for i in range(6)] + [("loose", i, i * 150_000 + (i == 3), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "inst_id string, event_id long, ts_us long, mid_px double")
    got = {(r.inst_id, r.event_id): (r.future_mid_px, r.exact_match) for r in labels.future_values(df, ["mid_px"], 200, 100, "auto").collect()}
    assert got["grid", 0] == (2.0, True) and got["grid", 4] == (None, None)
    assert got["loose", 0] == (2.0, False) and got["loose", 5] == (None, None)


def test_reconstruction_of_idle_and_empty_segments(spark):
    opening = spark.createDataFrame([("a", t, s, p, 1.0) for t in (0, 10, 20) for s, p in (("bid", 99.0), ("ask", 101.0))], "inst_id string, ts_us long, side string, price double, size double")
    deltas = spark.createDataFrame([("a", 3, 1, "bid", 99.5, 2.0), ("a", 20, 2, "bid", 99.0, 0.0), ("b", 3, 1, "bid", 1.0, 1.0)], "inst_id string, ts_us long, seq int, side string, price double, size double")
    rows = {r.ts_us: r for r in B.reconstruct_chunk(opening, deltas, 2, 25, bucket_us=100).collect()}
    assert sorted(rows) == [3, 10, 20] and rows[10].bid_px_01 == 99.0 and rows[3].bid_px_01 == 99.5 and rows[20].bid_px_01 is None and rows[20].mid_px is None
    assert {r.anchor_snapshot_us for r in rows.values()} == {0, 10, 20} and {r.reconstruction_mode for r in rows.values()} == {"event"}
    grid = {r.ts_us: r.anchor_snapshot_us for r in B.reconstruct_chunk(opening, deltas, 2, 25, "grid", 4, bucket_us=100).collect()}
    assert grid == {2: 0, 6: 0, 10: 10, 14: 10, 18: 10, 22: 20}
    single = B.reconstruct_chunk(opening, deltas, 2, 25, policy="single", bucket_us=100).collect()
    assert {r.anchor_snapshot_us for r in single} == {0} and sorted(r.ts_us for r in single) == [3, 20]
    with pytest.raises(ValueError):
        B.reconstruct_chunk(opening, deltas, 0, 1, "other")
    padded = B.padded_levels(opening.withColumn("level", F.lit(1)), 2)
    assert padded.count() == 12 and padded.where("price is null").count() == 6


def test_reconstruction_job_and_forensics(spark, tmp_path):
    opening = spark.createDataFrame([("a", 0, s, p, 1.0) for s, p in (("bid", 99.0), ("ask", 101.0))], "inst_id string, ts_us long, side string, price double, size double")
    deltas = spark.createDataFrame([("a", 3, 1, "bid", 99.5, 2.0), ("a", 3, 2, "bid", 99.5, 4.0), ("a", 70, 3, "ask", 100.5, 1.0)], "inst_id string, ts_us long, seq int, side string, price double, size double")
    B.reconstruct_job(opening, deltas, str(tmp_path / "b"), [(0, 50), (50, 100)], bucket_us=100)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    snaps = B.levels_to_wide(spark.createDataFrame([("a", 3, "bid", 1, 99.5, 4.0), ("a", 3, "ask", 1, 101.0, 1.0)], "inst_id string, ts_us long, side string, level int, price double, size double"), ("inst_id", "ts_us"))
    run = B.snapshot_aligned_run(snaps, opening, deltas)
    assert run["summary"].first().bid_match_rate == 1.0 and run["worst"].count() == 1
    s = B.sanity_counters(run["points"]).first()
    assert (s.n, s.crossed_real, s.match_share) == (1, 0, 1.0)
    real = B.wide_to_levels(snaps)
    start = opening.withColumn("seq", F.lit(0)).unionByName(deltas)
    found = B.order_forensics(real, start.withColumn("back", -F.col("seq")), 5, {"pipeline": ("back",), "fixed": ("seq",)}).first()
    assert not found.improved and found.max_sz_diff_fixed == 0 and found.max_sz_diff_pipeline == 2
    assert B.compare_forensic(real, real.where("side = 'bid'")).first().max_px_diff == 0.0


def test_targets_arguments_and_incomplete_rows(spark):
    df = spark.createDataFrame([("a", i, i * SECOND, 100.0 + i % 3) for i in range(10)], "inst_id string, event_id long, ts_us long, mid_px double")
    kept = passage.targets_dataset(df, 1.0, (2, 4), (1,), drop_incomplete=False)
    assert kept.count() == 10 and kept.where("long_hit_up_1t_within_4s is null").count() == 4 and kept.where("long_hit_up_1t_within_2s is null").count() == 2
    assert passage.targets_dataset(df, 1.0, (2, 4), (1,), step_rows=2).count() == 3
    for bad in ({"tick": 0.0}, {"horizons_s": ()}, {"thresholds": (-1,)}, {"step_rows": 0}):
        with pytest.raises(ValueError):
            passage.targets_dataset(df, **({"tick": 1.0, "horizons_s": (2,), "thresholds": (1,)} | bad))


def test_models(spark):
    df = spark.range(300).selectExpr("id AS ts_us", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS mid_px", "CAST(id % 7 > 4 AS INT) AS y", "CAST(id % 3 AS INT) AS k")
    model, scored, metrics = evaluate.train_model(df, "y", ["x", "mid_px"], ("ts_us",), least=10, rounds=2, depth=2)
    assert metrics.first().roc_auc > 0.9 and scored.count() == 45
    assert evaluate.feature_importance(model, ["x", "mid_px"])[0][0] == "x"
    rows = [r.asDict() for r in evaluate.group_experiment(df, "y", ["x", "mid_px"], ["SHORT_ONLY", "ALL_FEATURES"], ("ts_us",), least=10, rounds=2, depth=2).collect()]
    assert [r["n_features"] for r in rows] == [1, 2]
    assert "mid_px dominates" in evaluate.experiment_report(rows, {"ALL_FEATURES": [("mid_px", 0.9)]})
    assert evaluate.target_kind(df, "y") == "binary" and evaluate.target_kind(df, "k") == "multiclass"
    multi = evaluate.train_multiclass(df.withColumn("k", F.col("k").cast("double")), ["x"], "k", 3, rounds=1, depth=1)
    assert set(multi.transform(df.drop("k")).select("prediction").distinct().toPandas().prediction) <= {0.0, 1.0, 2.0}


def test_first_shard_with_a_tick(spark):
    df = spark.createDataFrame([("a", "s1", None), ("a", "s2", 0.1), ("a", "s3", 0.2)], "inst_id string, shard string, tick double")
    assert [tuple(r) for r in eda.first_with_tick(df).collect()] == [("a", "s2", 0.1)]


def test_sums_and_ranks_over_values(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0] + [float(i % 37) - 5 for i in range(400)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    key = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731  NaN is the highest
    known = [v for v in values if v is not None]

    def want(v):
        below, equal = sum(key(x) < key(v) for x in known), sum(key(x) == key(v) for x in known)
        return (below + (equal + 1) / 2) / len(known)

    got = {r.i: r.pct for r in with_average_rank_pct(rows, "v").collect()}
    assert got.keys() == set(range(len(values))) and got[0] is None
    assert all(abs(got[i] - want(v)) < 1e-12 for i, v in enumerate(values) if v is not None)
    per = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    for descending in (False, True):
        out = value_sums(per, "v", ["n"], descending, buckets=8).collect()
        for r in out:
            assert r.cum_n == sum(q.n for q in out if (key(q.v) >= key(r.v) if descending else key(q.v) <= key(r.v)))
    assert with_average_rank_pct(rows.where("false"), "v").count() == 0


def test_top_precision_with_missing_scores_and_ties(spark):
    data = [(i, [None, 0.2, 0.9, 0.9][i % 4], int(i % 3 == 0)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, s double, y int")
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for share in (0.0, 0.1, 0.3, 0.6, 0.9, 1.0):
        k = max(1, int(40 * share))
        r = evaluate.top_precision(df, "y", "s", share).first()
        assert (r.n, round(r.precision, 9)) == (k, round(sum(y for *_, y in order[:k]) / k, 9))
