"""Mixing sources to target weights by capped water-filling and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, quoted

#: Seeded order is cut into so many bins a source, so that no task sorts a whole source.
BINS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from sizes (source, source_size), one row a source.

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` times all sizes. A source whose part
    exceeds max_epochs times its size is clamped there and its excess goes to the rest by weight, until none exceeds. Clamped
    sources are those that fill first, a prefix in order of size by weight: source i is clamped if, with all before it
    clamped, its part still reaches its clamp. Works on one row a source, in JVM expressions only.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("clamped", F.col("weight") * F.col("left") >= F.col("cap") * F.col("open"))
    )
    end = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("left"), F.col("open"))))
    level = F.col("end")["left"] / F.col("end")["open"]
    after = F.col("end").isNotNull() & (
        F.struct((F.col("cap") / F.col("weight")).alias("a"), F.col("rank").alias("b"))
        >= F.struct(F.col("end")["col1"].alias("a"), F.col("end")["rank"].alias("b"))
    )
    return filled.withColumn("end", end.over(whole)).select(
        "source", "source_size", F.when(after, F.col("weight") * level).otherwise(F.col("cap")).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: bool = False,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of docs; keep: also `row`, a struct of all its columns as c0, c1, ...

    size: words of the text (null: 0). Every document is taken floor(target / source_size) times; of what is then missing,
    documents are taken once more in seeded order (MD5 of seed and id) until the words are reached, the last one in part. So a
    source's taken words are its target rounded down, and reruns agree. The order is summed in bins of its hash, whose
    offsets come from a pre-aggregated table, so the largest source is spread over as many tasks as any.

    A null source is a source of its own (last); a null id is ordered as an empty one; rows equal in id and size are
    ordered by a hash of their text, and interchangeable if that is equal too; a source without words has target 0; an empty table gives an empty result.
    """
    text, bits = F.col(quoted(text_col)).cast("string"), BINS.bit_length() - 1
    digest = F.md5(F.concat(F.lit(f"{seed}#"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))))
    spot = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    columns = [
        F.col(quoted(id_col)).alias("id"),
        F.col(quoted(source_col)).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        spot.alias("spot"),
        F.xxhash64(text).alias("hash"),
        F.shiftright(spot, 60 - bits).alias("bin"),
    ]
    sized = docs.select(*columns)
    if keep:
        rows = docs.select(*columns, F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"))
    else:
        rows = sized = cut(sized, "sized")  # words are counted once
    bins = cut(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    offsets = (
        bins.withColumnRenamed("source", "s")
        .withColumn("ahead", F.sum("bin_size").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select(
            "s",
            F.col("bin").alias("b"),
            F.coalesce("ahead", F.lit(0)).alias("ahead"),
            "source_size",
            "target",
            whole.alias("whole"),
            (F.floor("target").cast("bigint") - whole * F.col("source_size")).alias("rest"),
        )
    )
    order = Window.partitionBy("source", "bin").orderBy("spot", "id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))
    )
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("before")))
    return placed.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + part).alias("taken"),
        *(["row"] if keep else []),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken, with docs' columns.

    A document taken in part is cut after its words taken; the words of a cut text are joined by single blanks.
    """
    placed = mix(docs, text_col=text_col, keep=True, **options)
    at = docs.columns.index(text_col)
    text, size, taken = F.col(f"row.c{at}").cast("string"), F.col("size"), F.col("taken")
    copies = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = F.when(size > 0, taken - copies * size).otherwise(0)
    blank = r"[\x20\x09-\x0D]+"
    words = F.split(F.regexp_replace(text, rf"^{blank}", ""), blank)
    cut_text = F.when(rest > 0, F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " "))
    texts = F.concat(F.array_repeat(text, copies), F.when(rest > 0, F.array(cut_text)).otherwise(F.array().cast("array<string>")))
    return placed.select("row", F.explode(texts).alias("__text")).select(
        *(F.col("__text" if i == at else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))
    )
