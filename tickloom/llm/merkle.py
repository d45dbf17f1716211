"""Merkle manifest of a dataset: a tree a source and one over the sources, built as children arrive, and a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, drop_cuts, map_batches, quoted

#: The tree over all sources' subroots; a source's own tree has the source's number.
TOP = -1
#: Children that a task holds in unfinished parents before it hands them all on.
OPEN_CHILDREN = 1 << 18
_NODE = "tree bigint, level int, idx bigint, depth int, up_tree bigint, up_level int, up_idx bigint, place int, digest binary, children binary"
_EVENT = "tree bigint, level int, idx bigint, n bigint, digest binary"


def record_digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the values one after another, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)).cast("binary"), 256))


def joined_digest(digests: bytes) -> bytes:
    """The parent of children whose 32-byte digests follow each other: the SHA-256 of their hex texts."""
    return hashlib.sha256(digests.hex().encode()).digest()


def width(n: int, level: int, arity: int) -> int:
    """Nodes at `level` of a tree of n leaves."""
    return -(-n // arity**level)


def height(n: int, arity: int) -> int:
    """Levels above the leaves of a tree of n leaves: 0 for a lone leaf."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def path_of(index: int, n: int, arity: int) -> list[tuple[int, int]]:
    """(place among its parent's children, their number) of a leaf and each of its ancestors below the root."""
    out = []
    while n > 1:
        first = index - index % arity
        out.append((index - first, min(arity, n - first)))
        index, n = index // arity, -(-n // arity)
    return out


def fold(digest: bytes, path: list[tuple[int, int]], proof: bytes) -> bytes:
    """The root that a leaf's digest and its siblings' digests (32 bytes each, level by level, left to right) give."""
    at = 0
    for place, among in path:
        middle, end = at + 32 * place, at + 32 * (among - 1)
        digest = joined_digest(proof[at:middle] + digest + proof[middle:end])
        at = end
    if at != len(proof):
        raise ValueError("the proof has more siblings than the path")
    return digest


def _grow(events: DataFrame, sources: int, arity: int) -> DataFrame:
    """Combine child events (tree, level, idx, n, digest) within each task: a parent gathers its children's digests by place; as soon as it
    has as many as the tree's size gives it, it is emitted and is itself a child event of its own parent, a finished subroot one of
    the tree over all sources. Rows with `children` are finished nodes; the others are children whose parents are unfinished
    here, handed on as events. Children may come in any order; sorted ones keep one open parent a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("depth", pa.int32()), ("up_tree", pa.int64()), ("up_level", pa.int32())]
            + [("up_idx", pa.int64()), ("place", pa.int32()), ("digest", pa.binary()), ("children", pa.binary()), ("n", pa.int64())]
        )
        open_parents: dict[tuple[int, int, int, int], dict[int, bytes]] = {}
        held, rows, heights = 0, [], {sources: height(sources, arity)}

        def out() -> pa.RecordBatch:
            nonlocal rows
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
            return made

        def handed_on() -> None:
            nonlocal held
            for (tree, level, parent, n), children in open_parents.items():
                rows.extend((tree, level - 1, parent * arity + k, None, None, None, None, None, digest, None, n) for k, digest in children.items())
            open_parents.clear()
            held = 0

        for batch in batches:
            for tree, level, idx, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while True:
                    wide = width(n, level, arity)
                    if wide == 1:  # a subroot, or the root
                        if tree == TOP or sources == 1:
                            break
                        tree, level, idx, n, wide = TOP, 0, tree, sources, sources
                    key = (tree, level + 1, idx // arity, n)
                    children = open_parents.setdefault(key, {})
                    children[idx % arity] = digest
                    held += 1
                    among = min(arity, wide - key[2] * arity)
                    if len(children) < among:
                        break
                    del open_parents[key]
                    held -= among
                    own = b"".join(children[k] for k in range(among))
                    level, idx, digest = level + 1, key[2], joined_digest(own)
                    if n not in heights:
                        heights[n] = height(n, arity)
                    depth = heights[n] - level + (heights[sources] if tree != TOP else 0)
                    up = (tree, level + 1, idx // arity, idx % arity) if heights[n] > level else (TOP, 1, tree // arity, tree % arity)
                    if not depth:
                        up = (None,) * 4
                    rows.append((tree, level, idx, depth, *up, digest, own, n))
            if held > OPEN_CHILDREN:
                handed_on()
            if len(rows) >= 4096:
                yield out()
        handed_on()
        if rows:
            yield out()

    return events.mapInArrow(run, _NODE + ", n bigint")


def _numbered(rows: DataFrame, order: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with part and no, (part, *by, shift, size)): no + shift is a row's place, from 0, among those equal in `by`, which must lead
    `order`. Rows are dealt by ranges, equal ones spread by a seeded number, so a group of any size takes many tasks; only the
    runs of a group in each part are summed by a window."""
    dealt = rows.withColumn("spread", F.rand(13)).repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread")
    placed = cut(
        dealt.drop("spread").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("no")), "placed"
    )
    runs = placed.groupBy("part", *by).agg(F.min("no").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy(*by)
    return placed, runs.select(
        "part", *by, (F.sum("held").over(whole.orderBy("part")) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("size")
    )


def merkle_manifest(leaves: DataFrame, arity: int = 16) -> tuple[DataFrame, list[DataFrame]]:
    """leaves (id, source, leaf: 32 bytes, ...) with idx, n, source_no, sources, proof, subroot and root: the manifest and a proof a row;
    and the cuts that these rows read, for drop_cuts() once they are no longer needed.

    A source's leaves ascend by id (then by leaf); every `arity` consecutive nodes, the last run perhaps fewer, become their
    joined_digest until one, the subroot, is left (a lone leaf is its own). The subroots, ordered by source (null first,
    bytewise), make the root likewise. proof: the siblings' digests from the leaf up to the root; fold(leaf, path, proof) is the root.

    Leaves are numbered by ranges, so neighbours meet in a task and most parents are finished there (_grow); children of the
    others, some at each end of a task's runs, are shuffled by parent and combined again until none is left: at most a round
    a level. Proofs go down the reverse links from the root, a level at a time: each node joins its parent, which has `arity` children at most, so no
    key is hot however large a source is. Each round is written to the shared folder.

    Nulls are values of their own (a null id comes first); rows equal in all are leaves of their own; other columns pass
    unchanged and must not have a name of the result; an empty table gives no rows.
    """
    if arity < 2:
        raise ValueError(f"arity {arity} is less than 2")
    others = {c: f"x{i}" for i, c in enumerate(c for c in leaves.columns if c not in ("id", "source", "leaf"))}
    slim = cut(leaves.select("id", "source", "leaf", *(F.col(quoted(c)).alias(x) for c, x in others.items())), "leaves")  # texts are read once
    placed, runs = _numbered(slim, ["source", "id", "leaf"], ["source"])
    runs = held_runs = cut(runs, "runs")
    drop_cuts(slim)
    by_name, parts = _numbered(runs.select("source").distinct(), ["source"], [])
    named = cut(by_name.join(parts, "part").select(F.col("source").alias("s"), (F.col("no") + F.col("shift")).alias("source_no")), "sources")
    drop_cuts(by_name)
    sources = named.count()
    runs = runs.join(named, F.col("source").eqNullSafe(F.col("s"))).select(F.col("part").alias("p"), "s", "shift", F.col("size").alias("n"), "source_no")
    rows = placed.join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select(*slim.columns, (F.col("no") + F.col("shift")).alias("idx"), "n", "source_no", F.lit(sources).cast("bigint").alias("sources"))

    events = rows.select(F.col("source_no").alias("tree"), F.lit(0).alias("level"), "idx", "n", F.col("leaf").alias("digest"))
    rounds = []
    while True:
        rounds.append(cut(_grow(events, sources, arity), "nodes"))
        waiting = rounds[-1].where("children is null")
        if waiting.isEmpty():
            break
        parent = F.expr(f"idx div {arity}")
        events = waiting.select("tree", "level", "idx", "n", "digest").repartition("tree", "level", parent)
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.union(more)
    nodes = nodes.where("children is not null")

    # down from the root: a node's proof is its siblings and then its parent's proof
    deepest = nodes.agg(F.max("depth")).first()[0]
    subroot = F.when(F.col("tree") != TOP, F.col("digest"))
    known = [nodes.where("depth = 0").select("tree", "level", "idx", "digest", "children", F.lit(b"").alias("above"), subroot.alias("subroot"), F.col("digest").alias("root"))]
    for depth in range(1, (deepest or 0) + 1):
        up = known[-1].select(*(F.col(c).alias(f"of_{c}") for c in ("tree", "level", "idx", "children", "above", "subroot")), "root")
        own = nodes.where(F.col("depth") == depth).drop("n")
        met = own.join(up, (F.col("up_tree") == F.col("of_tree")) & (F.col("up_level") == F.col("of_level")) & (F.col("up_idx") == F.col("of_idx")))
        above = F.concat(_siblings(F.col("of_children"), F.col("place")), F.col("of_above"))
        known.append(cut(met.select("tree", "level", "idx", "digest", "children", above.alias("above"), F.coalesce("of_subroot", subroot).alias("subroot"), "root"), "proofs"))
    links = known[0]
    for more in known[1:]:
        links = links.union(more)
    links = links.where("level = 1").select(*(F.col(c).alias(f"of_{c}") for c in ("tree", "idx", "children", "above", "subroot")), F.col("root").alias("of_root"))

    alone = F.col("n") == 1
    rows = rows.withColumn("place", F.when(alone, F.col("source_no")).otherwise(F.col("idx")))
    tree = F.when(alone, F.lit(TOP).cast("bigint")).otherwise(F.col("source_no"))
    met = rows.join(links, (tree == F.col("of_tree")) & (F.expr(f"place div {arity}") == F.col("of_idx")), "left")
    proof = F.coalesce(F.concat(_siblings(F.col("of_children"), F.col("place") % arity), F.col("of_above")), F.lit(b""))
    found = met.select(
        *(F.col(others.get(c, c)).alias(c) for c in leaves.columns), "idx", "n", "source_no", "sources", proof.alias("proof"), F.when(alone, F.col("leaf")).otherwise(F.col("of_subroot")).alias("subroot"),
        F.coalesce("of_root", "leaf").alias("root"),
    )
    return found, [placed, held_runs, named, *rounds, *known[1:]]


def _siblings(children: Column, place: Column) -> Column:
    """children without the 32 bytes at `place`."""
    return F.concat(F.substring(children, F.lit(1), (place * 32).cast("int")), F.substring(children, (place * 32 + 33).cast("int"), F.length(children)))


def fold_proofs(rows: DataFrame, leaf_col: str = "leaf", arity: int = 16) -> DataFrame:
    """rows of merkle_manifest with proof_sha256 (joined_digest of the proof) and folded, the root that leaf_col and the proof give, in
    place of proof; folded equals root just where leaf_col holds the leaf that the manifest was made from."""
    names = rows.columns
    at = [names.index(c) for c in (leaf_col, "proof", "idx", "n", "source_no", "sources")]
    kept = [i for i, c in enumerate(names) if c != "proof"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, roots = [], []
            for leaf, proof, idx, n, source_no, sources in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                digests.append(joined_digest(proof))
                roots.append(fold(leaf, path_of(idx, n, arity) + path_of(source_no, sources, arity), proof))
            columns = [*(batch.column(i) for i in kept), pa.array(digests, pa.binary()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([*(rows.schema.fields[i] for i in kept), T.StructField("proof_sha256", T.BinaryType()), T.StructField("folded", T.BinaryType())])
    return map_batches(rows, run, schema)
