"""Views that map the test tables to this domain: the same arithmetic as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = 0.01
DAY = 86_400_000_000

_LEVELS = ", ".join(
    f"value - (1 + event_id % 5 + {2 * (i - 1)}) / 1e2 AS bid_px_{i:02d}, CAST((event_id * 7 + {i * 13}) % 50 AS DOUBLE) AS bid_sz_{i:02d}, "
    f"value + (1 + event_id % 5 + {2 * (i - 1)}) / 1e2 AS ask_px_{i:02d}, CAST((event_id * 11 + {i * 17}) % 50 AS DOUBLE) AS ask_sz_{i:02d}"
    for i in range(1, 11)
)
_BOOK = f"SELECT inst_id, ts_us, event_id, value, {_LEVELS} FROM t"
_MID = "SELECT *, (bid_px_01 + ask_px_01) / 2e0 AS mid_px, ask_px_01 - bid_px_01 AS spread_px FROM b"
_DELTA_PARTS = (
    "CAST(user_id % 4 AS {text})", "event_id", "CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END",
    "CASE WHEN event_id % 2 = 0 THEN 1e2 - (k % 30) / 1e1 ELSE 1e2 + (k % 30 + 1) / 1e1 END",
    "CASE WHEN event_type = 'error' THEN 0e0 ELSE CAST(floor(value) AS DOUBLE) + 1 END",
)
_DELTA = ", ".join(f"{x} AS {n}" for x, n in zip(_DELTA_PARTS, ("inst_id", "seq", "side", "price", "size"), strict=True))

#: Common table expressions of DuckDB by name.
CTE = {
    "ticks": "ticks AS (SELECT event_type AS inst_id, epoch_us(ts) AS ts_us, event_id, value AS mid_px FROM events)",
    "book": f"t AS (SELECT event_type AS inst_id, epoch_us(ts) AS ts_us, event_id, value FROM events), b AS ({_BOOK}), book AS ({_MID})",
    "deltas": "deltas AS (SELECT ts_us, "
    + _DELTA.format(text="VARCHAR")
    + " FROM (SELECT *, epoch_us(ts) AS ts_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e)",
    "daily": "daily AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS inst_id, epoch_us(l_shipdate) AS ts_us, l_orderkey, l_partkey, l_linenumber, l_quantity AS value FROM lineitem)",
    "scores": "scores AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 1e2 AS score FROM labels)",
}


def sql(body: str, *views: str) -> str:
    """body is SQL that may begin with its own common table expressions."""
    body = body.strip()
    parts = [CTE[v] for v in views]
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH " + ", ".join(parts)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def _micros(column: str) -> str:
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({column} AS timestamp_ntz))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("event_type AS inst_id", f"{_micros('ts')} AS ts_us", "event_id", "value AS mid_px")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).selectExpr("event_type AS inst_id", f"{_micros('ts')} AS ts_us", "event_id", "value")
    b = t.selectExpr("inst_id", "ts_us", "event_id", "value", *_LEVELS.split(", "))
    return b.selectExpr("*", "(bid_px_01 + ask_px_01) / 2e0 AS mid_px", "ask_px_01 - bid_px_01 AS spread_px")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("ts_us", F.expr(_micros("ts")))
    inst, seq, side, price, size = (_DELTA_PARTS[i].format(text="STRING") for i in range(5))
    return e.select("ts_us", F.expr(inst).alias("inst_id"), F.expr(seq).alias("seq"), F.expr(side).alias("side"), F.expr(price).alias("price"), F.expr(size).alias("size"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "CAST(l_suppkey % 5 AS STRING) AS inst_id", f"{_micros('l_shipdate')} AS ts_us", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity AS value"
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality AS y", "(doc_id * 37 % 101) / 1e2 AS score")
