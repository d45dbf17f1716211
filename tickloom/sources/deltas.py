"""JSON depth deltas: arrays of [price, size, ...] or of {"price", "size"}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_levels(text: Column) -> Column:
    """array<struct<price double, size double>>: what is blank, no list or not numeric gives NULL entries or an empty array."""
    pairs = F.from_json(text, "array<array<string>>")
    objects = F.from_json(text, "array<struct<price:string,size:string>>")
    number = lambda c: c.try_cast("double")
    from_pairs = F.transform(pairs, lambda x: F.struct(number(F.get(x, F.lit(0))).alias("price"), number(F.get(x, F.lit(1))).alias("size")))
    from_objects = F.transform(objects, lambda x: F.struct(number(x["price"]).alias("price"), number(x["size"]).alias("size")))
    empty = F.array().cast("array<struct<price:double,size:double>>")
    return F.coalesce(F.when(F.try_element_at(pairs, F.lit(1)).isNotNull(), from_pairs), F.when(F.try_element_at(objects, F.lit(1)).isNotNull(), from_objects), empty)


def explode_deltas(messages: DataFrame, keep: tuple[str, ...] = ("inst_id", "ts_us", "msg_seq"), bids: str = "bids_delta", asks: str = "asks_delta") -> DataFrame:
    """A row per changed level: keep, side, side_ord (bids first), delta_pos, price, size; entries without two numbers are skipped."""
    sides = F.array(*(F.struct(F.lit(n).alias("side"), F.lit(o).alias("side_ord"), parsed_levels(F.col(c)).alias("levels")) for o, (n, c) in enumerate((("bid", bids), ("ask", asks)))))
    rows = messages.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.side", "s.side_ord", F.posexplode("s.levels").alias("delta_pos", "l"))
    return rows.where("l.price is not null and l.size is not null").select(*keep, "side", "side_ord", "delta_pos", "l.price", "l.size")


def side_name(side: Column) -> Column:
    s = F.lower(F.trim(side.cast("string")))
    return F.when(s.isin("1", "bid", "bids", "buy"), "bid").when(s.isin("2", "ask", "asks", "sell"), "ask").otherwise(s)
