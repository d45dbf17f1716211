"""Character matrices, substring hashes and a bounded sample of labelled rows: shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = np.uint64(0x100000001B3)


def char_matrix(words: list[str]) -> np.ndarray:
    """Code points, one row a word, zero after its end."""
    a = np.array(words, dtype=np.str_)
    width = max(1, a.dtype.itemsize // 4)
    return np.ascontiguousarray(a).view(np.uint32).reshape(len(words), width)


def substring_hashes(chars: np.ndarray, longest: int) -> list[np.ndarray]:
    """[m - 1]: the polynomial hashes (mod 2^64) of all substrings of m characters, one column a start."""
    c = chars.astype(np.uint64) + np.uint64(1)
    out = [c]
    for m in range(2, min(longest, c.shape[1]) + 1):
        out.append(out[-1][:, :-1] * BASE + c[:, m - 1 :])
    return out


def bounded_sample(rows: DataFrame, by: str, per_class: int, order: Column) -> DataFrame:
    """At most per_class rows of each value of `by` (not null), the first in `order`, a hash in [0, 2^32).

    Rows are first thinned by their hash to somewhat more than needed, so the final ranking sorts a bounded number.
    """
    counts = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    thin = rows.withColumn("__o", order).join(F.broadcast(counts), F.col(by) == F.col("__by"))
    thin = thin.where(F.col("__o") * F.col("__n") < F.lit((1.3 * per_class + 50) * 2**32))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__o"))
    return thin.withColumn("__rank", rank).where(F.col("__rank") <= per_class).select(*rows.columns)


def distinct_sample(rows: DataFrame, by: str, per_class: int) -> DataFrame:
    """(by, text): at most per_class different texts of each value of `by`, those of lowest CRC-32 (then XXH64).

    Copies are collapsed first, as hashes and combined on the map side, so a text copied very often is one row; only the chosen
    hashes, at most per_class a class and so few, then meet the texts.
    """
    marked = rows.select(by, "text", F.crc32("text").alias("crc"), F.xxhash64("text").alias("hash"))
    hashes = marked.groupBy(by, "crc", "hash").agg(F.count("*").alias("copies"))
    picked = bounded_sample(hashes, by, per_class, F.col("crc")).select(F.col(by).alias("picked_by"), F.col("crc").alias("picked_crc"), F.col("hash").alias("picked_hash"))
    found = marked.join(F.broadcast(picked), (F.col(by) == F.col("picked_by")) & (F.col("hash") == F.col("picked_hash")) & (F.col("crc") == F.col("picked_crc")))
    return found.groupBy(by, "crc", "hash").agg(F.first("text").alias("text")).select(by, "text")
