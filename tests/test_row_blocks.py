"""Row-count windows over blocks of rows against windows over whole instruments."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions.timewin import full_frame, in_row_blocks, numbered, ordered, with_rn


@pytest.fixture(scope="module")
def ticks(spark):
    """Three instruments (one NULL), bursts and gaps of hours, equal times, unknown times and a column named rn."""
    return spark.range(600).selectExpr(
        "case when id % 11 = 0 then null when id % 3 = 0 then 'a' else 'b' end as inst_id",
        "case when id % 97 = 5 then null else cast(floor(id / 4) * 1000000 + floor(id / 150) * 9000000000 as bigint) end as ts_us", "id as event_id", "cast(hash(id) % 100 as double) as x", "id as rn"
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_numbers(ticks):
    plain = ticks.drop("rn")
    assert rows(numbered(plain).select("event_id", "rn")) == rows(with_rn(plain).select("event_id", "rn"))


@pytest.mark.parametrize(("before", "after", "block"), [(5, 0, 10), (0, 4, 8), (5, 4, 11), (6, 5, 1), (5, 4, 1 << 16)])
def test_blocks(ticks, before, after, block):
    def build(df, w):
        out = {"back": F.coalesce(F.lag("x", before).over(w), F.lit(-1.0)), "low": full_frame(F.min("x"), w, before)} if before else {}
        out |= {"ahead": F.lead("x", after).over(w), "most": F.max("x").over(w.rowsBetween(1, after))} if after else {}
        return df.withColumns(out)

    got, want = in_row_blocks(ticks, build, before, after, block=block), build(ticks, ordered())
    assert got.columns == want.columns and rows(got.drop("inst_id", "ts_us")) == rows(want.drop("inst_id", "ts_us"))


def test_no_rows(ticks):
    assert in_row_blocks(ticks.where("false"), lambda df, w: df.withColumn("y", F.lag("x").over(w)), 1).count() == 0
