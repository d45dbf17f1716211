"""Streaming forms: windowed means with late data, and a keyed book that turns deltas into level rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_profile(stream: DataFrame, value: str, time_col: str = "ts_event", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Mean and deviation of `value` by instrument and tumbling window; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(time_col, late).groupBy("inst_id", F.window(time_col, width).alias("w")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    ).select("inst_id", F.col("w.start").alias("start"), "n", "mean", "std")


def book_top(deltas: DataFrame) -> DataFrame:
    """(inst_id, ts_us, bid_px, bid_sz, ask_px, ask_sz) after all deltas of each time in a micro-batch; deltas: inst_id, ts_us, seq, side,
    price, size. The state is one price map a side; a size at or below zero deletes."""
    schema = "inst_id string, ts_us bigint, bid_px double, bid_sz double, ask_px double, ask_sz double"
    state_schema = "side array<string>, price array<double>, size array<double>"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book: dict[tuple[str, float], float] = {}
        if state.exists:
            book = {(s, p): z for s, p, z in zip(*state.get, strict=True)}
        rows = pd.concat(list(batches)).sort_values(["ts_us", "seq"])
        out = []
        for ts, part in rows.groupby("ts_us", sort=True):
            for side, price, size in zip(part["side"], part["price"], part["size"], strict=True):
                if side not in ("bid", "ask"):
                    raise ValueError(f"unknown side: {side}")
                if size > 0:
                    book[side, price] = size
                else:
                    book.pop((side, price), None)
            bids, asks = ({p: z for (s, p), z in book.items() if s == name} for name in ("bid", "ask"))
            bid, ask = max(bids, default=None), min(asks, default=None)
            out.append((key[0], ts, bid, bids.get(bid), ask, asks.get(ask)))
        keys = list(book)
        state.update(([k[0] for k in keys], [k[1] for k in keys], [book[k] for k in keys]))
        yield pd.DataFrame(out, columns=["inst_id", "ts_us", "bid_px", "bid_sz", "ask_px", "ask_sz"]).astype({c: "float64" for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")})

    return deltas.groupBy("inst_id").applyInPandasWithState(fold, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
