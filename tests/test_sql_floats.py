"""Queries against their SQL where a price is zero, where times are equal and where a value lies next to a half."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans.queries import ORACLE_SQL, QUERIES
from tickloom.schema import float_divide, float_ln, round_scaled


def exact(df, columns):
    cell = lambda v: None if v is None or v is pd.NA else v if isinstance(v, str) else repr(float(v))
    return sorted((tuple(map(cell, r)) for r in df.select(*columns).collect()), key=repr)


def compared(spark, tmp_path, name, rows, drop=()):
    """The query's rows and its SQL's over events of (ts in microseconds, event_type, value), infinities and NaN as they are."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, us BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", [(i, us, i % 7, kind, value, f'{{"k": {i % 100}}}') for i, (us, kind, value) in enumerate(rows)])
    con.execute(f"COPY (SELECT event_id, make_timestamp(us) AS ts, user_id, event_type, value, props FROM e) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    con.execute(f"COPY ({ORACLE_SQL[name]}) TO '{tmp_path}/want.parquet' (FORMAT parquet)")
    columns = sorted(set(got.columns) - set(drop))
    return exact(got, columns), exact(spark.read.parquet(f"{tmp_path}/want.parquet"), columns)


ZEROS = [(1_700_000_000_000_000 + i * 1_000_003, "a" if i % 3 else "b", 0.0 if i % 40 == 7 else 20.0 + i * 37 % 11) for i in range(150)]


@pytest.mark.parametrize("name", ["flow_proxies", "trend_features", "partial_windows"])
def test_a_mid_of_zero_is_as_in_sql(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, name, ZEROS)
    assert len(got) == len(ZEROS) and got == want


def test_level_heat_keeps_events_of_equal_time(spark, tmp_path):
    rows = [(1_700_000_000_000_000 + i // 3 * 1_000_000, "a", 20.0 + i) for i in range(30)]
    got, want = compared(spark, tmp_path, "level_heat", rows, ["size_diff"])  # the SQL leaves the order of equal times open
    assert len(got) == 4 * len(rows) and got == want
    sizes = {("bid", 1): (7, 13), ("ask", 2): (11, 34)}
    diffs = QUERIES["level_heat"](spark, str(tmp_path))
    for (side, level), (m, c) in sizes.items():
        size = [float((i * m + c) % 50) for i in range(len(rows))]
        found = [r[0] for r in diffs.where((F.col("side") == side) & (F.col("level") == level)).select("size_diff").collect()]
        assert sorted(found) == sorted([0.0] + [b - a for a, b in zip(size, size[1:], strict=False)])


def test_rounding_next_to_a_half_is_as_in_sql(spark, tmp_path):
    x = [(a / 100 - b / 100) / (b / 100) for a in range(1, 4000) for b in (64, 128, 320, 640)]  # some print as a half in the seventh place
    want = [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (SELECT unnest(?) AS x)", params=[x]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    assert [r[0] for r in rows.orderBy("i").select(round_scaled(F.col("x"), 6)).collect()] == want
    assert [r[0] for r in rows.orderBy("i").select(F.round("x", 6)).collect()] != want


def test_float_division_and_logarithm(spark):
    r = spark.createDataFrame([(1.0,)], "a double").select(
        float_divide(F.col("a"), F.lit(0.0)), float_divide(-F.col("a"), F.lit(0.0)), float_divide(F.col("a") * 0, F.lit(0.0)), float_divide(F.col("a"), F.lit(4.0)),
        float_divide(F.col("a"), F.lit(None).cast("double")), float_ln(F.col("a") * 0), float_ln(F.col("a")), float_ln(-F.col("a")),
    ).first()
    assert r[0] == math.inf and r[1] == -math.inf and math.isnan(r[2]) and r[3] == 0.25 and r[4] is None and r[5] == -math.inf and r[6] == 0.0 and r[7] is None


DUST = [(1_700_000_000_000_000 + i * 1_000_003, "a" if i % 50 == 24 else "b", 20.01 + i // 50 % 7 * 1e-5) for i in range(3000)]  # the rows of "a" have equal sizes and mids that differ little


@pytest.mark.parametrize(("name", "column"), [("flow_proxies", "microprice_diff"), ("flow_proxies", "micro_minus_mid_bps"), ("trend_features", "log_mid_slope_50"), ("trend_features", "bid_size_drop_pct")])
def test_zero_keeps_its_sign_as_in_sql(spark, tmp_path, name, column):
    got, want = compared(spark, tmp_path, name, DUST)
    place = sorted(QUERIES[name](spark, str(tmp_path)).columns).index(column)
    assert len(got) == len(DUST) and any(r[place] == "-0.0" for r in want) and got == want


def test_rounding_to_zero_keeps_the_sign(spark):
    x = [-1e-9, 1e-9, -0.0, 0.0, -4e-7, -6e-7, float("inf"), float("-inf"), float("nan"), None]
    want = [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (SELECT unnest(?) AS x)", params=[x]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    assert [repr(r[0]) for r in rows.orderBy("i").select(round_scaled(F.col("x"), 6)).collect()] == list(map(repr, want))


def test_level_heat_takes_all_levels(spark, tmp_path):
    rows = [(1_700_000_000_000_000 + i * 1_000_000, "ab"[i % 2], 20.0 + i) for i in range(30)]
    got, want = compared(spark, tmp_path, "level_heat", rows)
    assert len(got) == 20 * len(rows) and got == want
    found = QUERIES["level_heat"](spark, str(tmp_path)).groupBy("side", "level").count().collect()
    assert sorted(found) == sorted((side, level, len(rows)) for side in ("bid", "ask") for level in range(1, 11))
