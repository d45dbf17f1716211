"""What several operators need: word and batch helpers, cut points in the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java and Python regular expressions spell it; bytes.split() finds the same words.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset and the master is local (tests), a temporary one is set once;
    on a cluster that raises, since a local folder of the driver is not seen by executors."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if root := sc.getCheckpointDir():
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def make_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cuts(*cuts: DataFrame) -> None:
    """Remove what cut() wrote, once nothing that is still to be computed reads it."""
    for df in cuts:
        drop_path(df.sparkSession, df._cut_path)


#: Bits of may_hold's bitmap: 8 MB, whatever the number of keys.
BITMAP_BITS = 1 << 26


def may_hold(df: DataFrame, hash_col: str, keys: DataFrame, key_col: str, flag: str) -> DataFrame:
    """df with `flag`: false only where hash_col is none of the 64-bit hashes key_col of keys. A bitmap of BITMAP_BITS bits, 4 KB a row, is sent
    to all tasks, so rows that meet nothing need not be shuffled with their texts; the more keys, the more rows pass for nothing."""
    of = lambda c: F.pmod(c, F.lit(BITMAP_BITS)) + 1  # noqa: E731  bitmap functions count from 1
    bits = keys.select(of(F.col(key_col)).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bits_of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    met = df.withColumn("at", of(F.col(hash_col))).join(F.broadcast(bits), F.bitmap_bucket_number("at") == F.col("bits_of"), "left")
    spot = F.expr("cast(bitmap_bit_position(at) as int)")
    byte = F.conv(F.hex(F.substring("bits", (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*(F.col(quoted(c)) for c in df.columns), F.coalesce(F.floor(byte / F.pow(F.lit(2), spot % 8)) % 2 == 1, F.lit(False)).alias(flag))


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from all columns of df in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow for columns of any name: run sees c0, c1, ... in df's order."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def docs_in(
    batches: Iterator[pa.RecordBatch], at: int, budget: int = 4 << 20, binary: bool = False
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about `budget` bytes of column `at` each (a longer text comes alone), and that column's values.

    binary: the values are UTF-8 bytes, else str. Null stays None.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > budget or i - begin >= 4096:
                part = batch.slice(begin, i - begin)
                yield part, _values(part.column(at), binary)
                begin, held = i, 0
            held += int(n)
        if begin < len(lengths):
            part = batch.slice(begin)
            yield part, _values(part.column(at), binary)
        part = batch = None
        pa.default_memory_pool().release_unused()  # workers are used again; what they hold counts for the executor


def _values(column: pa.Array, binary: bool) -> list:
    return (column.cast(pa.binary()) if binary else column).to_pylist()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of edges (src, dst: long); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each is a grouped minimum (combined on the map side)
    and an equality join with it. The minima are written before the join, so both its sides are plain shuffles and adaptive
    execution can split a centre of any degree. Self-loops and null ends carry no link and are ignored; no edges give an empty
    result. Each round ends in the shared folder, and what it has read is removed.
    """
    spark = edges.sparkSession
    state = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop_cuts(state, least, large, low)
        state = fresh
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(state.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
