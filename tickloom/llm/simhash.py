"""SimHash near-duplicates: deletion-variant index over few segments, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, cut, docs_in, drop_cuts, free_names, quoted

#: Buckets of at most so many fingerprints are compared pair by pair, larger ones by pivots: both give the same components.
SMALL_BUCKET = 48
#: Larger buckets are dealt in blocks of this many, each pair of blocks to a task of its own.
BLOCK = 2048


def fingerprints_of(texts: list[bytes | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text's lower-cased (A-Z) words' shingles by XXH64; texts without words get zero. As signed 64-bit."""
    out = np.zeros(len(texts), np.uint64)
    hashes, owners, sizes = [], [], []
    hash_of = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        n = len(words) - shingle + 1
        if n <= 1:
            hashes.append(hash_of(joined, seed))
            n = 1
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: n - 1].tolist()]
            hashes += [hash_of(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        owners.append(i)
        sizes.append(n)
    if not owners:
        return out.view(np.int64)
    h = np.array(hashes, np.uint64).astype(">u8")
    begins = np.r_[0, np.cumsum(sizes)]
    block = 1 << 15
    counts = np.zeros((len(owners), 64), np.int64)
    for a in range(0, len(h), block):  # bit counts in blocks, so a long text takes no more memory
        b = min(a + block, len(h))
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
        cuts = np.maximum(begins[lo:hi], a) - a
        counts[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    over = 2 * counts > np.array(sizes)[:, None]
    out[owners] = np.packbits(over, axis=1).view(">u8")[:, 0]
    return out.view(np.int64)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, row_hash, fp) for each row: fp the SimHash as a signed long, row_hash XXH64 of the text (tells rows of one id apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in docs_in(batches, 2, 1 << 20, binary=True):
            fp = fingerprints_of(texts, shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "row_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("row_hash"), text.alias("t")).mapInArrow(
        run, f"id {kind}, row_hash bigint, fp bigint"
    )


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of 64 bits of which one holds at most one of max_bits differing bits."""
    m = max_bits // 2 + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def star_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (places in fps) that connect just what links within max_bits connect, fewer than len(fps) of them.

    Pivots take all that are left within max_bits as their star. Two stars of different components can only be linked if
    their pivots differ in at most 3 * max_bits bits; then members are compared until the first link. So a dense group costs
    a pass per pivot and yields a tree, not its pairs.
    """
    left, stars, links = np.arange(len(fps)), [], []
    while len(left):
        near = np.bitwise_count(fps[left] ^ fps[left[0]]) <= max_bits
        stars.append(left[near])
        links += [(int(left[0]), int(x)) for x in left[near][1:]]
        left = left[~near]
    pivots = fps[[s[0] for s in stars]]
    part = np.arange(len(stars))
    for t in range(1, len(stars)):
        for s in np.flatnonzero(np.bitwise_count(pivots[:t] ^ pivots[t]) <= 3 * max_bits):
            if part[s] == part[t]:
                continue
            small, large = sorted((stars[s], stars[t]), key=len)
            for x in small:
                hit = np.flatnonzero(np.bitwise_count(fps[large] ^ fps[x]) <= max_bits)
                if len(hit):
                    links.append((int(x), int(large[hit[0]])))
                    part[part == part[t]] = part[s]
                    break
    return links


def bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows of equal key (adjacent): variant, its bit above 32 bits, its tile above 38. A pair of a small
    bucket is given in its first bucket only. Larger buckets give fewer links that join the same fingerprints (star_links)."""
    segs = segments(max_bits)
    owner = np.array([s for s, (_, width) in enumerate(segs) for _ in range(width)])
    masks = np.array([((1 << width) - 1) << low for low, width in segs], np.uint64)
    lows = np.array([low for low, _ in segs])
    first = np.r_[True, keys[1:] != keys[:-1]]
    begins = np.flatnonzero(first)
    sizes = np.diff(np.r_[begins, len(keys)])
    size = np.repeat(sizes, sizes)
    left, right = [], []
    at = np.flatnonzero((size > 1) & (size <= SMALL_BUCKET))
    for k in range(1, SMALL_BUCKET):
        at = at[at + k < len(keys)]
        at = at[keys[at] == keys[at + k]]
        if not len(at):
            break
        x = fps[at] ^ fps[at + k]
        hit = at[np.bitwise_count(x) <= max_bits]
        if len(hit):
            x = fps[hit] ^ fps[hit + k]
            bit = keys[hit] >> 32 & 63
            seg = owner[bit]
            inside = x & masks[seg]
            here = (inside == np.uint64(1) << bit.astype(np.uint64)) | ((inside == 0) & (bit == lows[seg]))
            for s, mask in enumerate(masks):
                here &= (s >= seg) | (np.bitwise_count(x & mask) > 1)
            hit = hit[here]
            left.append(fps[hit])
            right.append(fps[hit + k])
    for b, n in zip(begins[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        own = fps[b : b + n]
        links = np.array(star_links(own, max_bits), np.int64).reshape(-1, 2)
        left.append(own[links[:, 0]])
        right.append(own[links[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def fingerprint_links(fps: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that join all fingerprints (column fp, distinct) within max_bits, directly or by way of others.

    Of the segments, one differs by at most one bit, so the two share the variant in which that bit is a wildcard: each
    fingerprint is indexed under 64 variants, equal variants meet by a shuffle on the variant, and every link is verified on
    all 64 bits. Rows are 16 bytes; a bucket of many close fingerprints is reduced to a tree where it lies (star_links). A bucket
    of over `block` fingerprints is dealt in blocks, and each pair of its blocks is a bucket of its own, so no task holds more
    than two blocks of a bucket and none of its pairs is left out.
    """
    variants = [
        (F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << (bit - low)))) + F.lit(bit << 32))
        for low, width in segments(max_bits)
        for bit in range(low, low + width)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(keys, own, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            keys, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on in the next batch
            if last:
                parts = [*held, (keys[:last], own[:last])]
                yield out(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                held = [(keys[last:], own[last:])]
            elif held and held[-1][0][-1] != keys[0]:
                yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [(keys, own)]
            else:
                held.append((keys, own))
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    indexed = fps.select(F.explode(F.array(*variants)).alias("key"), "fp")
    large = cut(indexed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.greatest(own, other) * F.col("blocks") + F.least(own, other))
        joined = indexed.join(large, F.col("key") == F.col("k"), "left").withColumn("tile", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(tiles)))
        indexed = joined.select((F.col("key") + F.shiftleft(F.col("tile").cast("bigint"), 38)).alias("key"), "fp")
    return indexed.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "src bigint, dst bigint")


def near_duplicates(
    docs: DataFrame, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42
) -> DataFrame:
    """(id, row_hash, fp, component_id): component_id is the smallest id reachable by links of at most max_bits differing bits.

    Equal fingerprints are one node, so copies never multiply. Texts without words (null too) share fingerprint zero and are
    linked like any other; rows with a null id take part, and count for component_id only if all of the group are null;
    repeated rows give repeated rows; other columns are not read; an empty table gives an empty result.
    """
    return _with_components(docs, max_bits, id_col, text_col, shingle, seed).drop("component")


def _with_components(docs: DataFrame, max_bits: int, id_col: str, text_col: str, shingle: int = 4, seed: int = 42) -> DataFrame:
    """near_duplicates and component: the least fingerprint of the group, known also where all its ids are null."""
    rows = cut(fingerprint(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    labelled = cut(nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "labelled")
    # each side of these joins is written before, so a large component or a fingerprint of many copies can be split
    ids = cut(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = cut(labelled.join(ids, "component").select("fp", "component_id", "component"), "named")
    drop_cuts(nodes, labelled, ids)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "row_hash", "fp", "component_id", "component")


def keep_one(docs: DataFrame, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, the one with the smallest (id, hash of text); docs' columns only, of any
    names. Of rows equal in id and text, which one stays is open."""
    found = _with_components(docs, max_bits, id_col, text_col).select(F.col(quoted(id_col)).alias("id"), "row_hash", "component")
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), "row_hash")).alias("row"))
    own, copy, key, hashed = free_names(docs, "row_hash", "copy", "chosen_id", "chosen_hash")
    chosen = chosen.select(F.col("row.id").alias(key), F.col("row.row_hash").alias(hashed)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.col(quoted(text_col)).cast("string")))
    kept = rows.join(chosen, F.col(quoted(id_col)).eqNullSafe(F.col(key)) & (F.col(own) == F.col(hashed)), "left_semi")
    once = Window.partitionBy(F.col(quoted(id_col)), own).orderBy(F.lit(1))
    return kept.withColumn(copy, F.row_number().over(once)).where(F.col(copy) == 1).select(*(F.col(quoted(c)) for c in docs.columns))
