"""Embedding near-duplicates over an inverted multi-index: two codebooks, multi-sequence traversal, verified cosines."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, cut

#: Vectors of a cell in a block: larger cells are dealt in tiles, each a block of members by a block of queries. Up to MOST_BLOCKS
#: blocks a side they have SMALL_BLOCK vectors, beyond that more, up to BLOCK.
SMALL_BLOCK, BLOCK, MOST_BLOCKS = 256, 4096, 64
#: Queries compared at a time.
QUERIES = 1024


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two vector halves, and how far beyond its nearest cell a query's traversal goes (squared distance)."""

    first: np.ndarray
    second: np.ndarray
    reach: float


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by plain sums a component, so a row's values do not depend on the rows beside it."""
    out = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        out += (x[:, d, None] - centres[None, :, d]) ** 2
    return out


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 1 << 20) -> np.ndarray:
    """The nearest centre of each row, in parts of about `rows` distances."""
    step = max(1, rows // len(centres))
    return np.concatenate([_squared(x[i : i + step], centres).argmin(axis=1) for i in range(0, len(x), step)])


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sizes = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            sums = np.bincount(near, x[:, d], len(centres))
            centres[:, d] = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres[:, d])
    return centres


def fit_index(sample: np.ndarray, codes: int, cosine: float, recall: float = 0.99, seed: int = 11) -> MultiIndex:
    """Codebooks by k-means on a sample of unit vectors; reach is set so that of partners made at exactly the least cosine in
    random directions, the hardest to find, a share `recall` lies within it."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    a, b = _centres(sample[:, :half], codes, rng), _centres(sample[:, half:], codes, rng)
    q = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
    noise = rng.normal(size=q.shape)
    noise -= (noise * q).sum(axis=1, keepdims=True) * q
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = cosine * q + np.sqrt(1 - cosine**2) * noise
    beyond = np.zeros(len(q))
    for r in range(0, len(q), 100):
        x, y = q[r : r + 100], partner[r : r + 100]
        da, db = _squared(x[:, :half], a), _squared(x[:, half:], b)
        i, j = _squared(y[:, :half], a).argmin(axis=1), _squared(y[:, half:], b).argmin(axis=1)
        rows = np.arange(len(x))
        beyond[r : r + 100] = da[rows, i] + db[rows, j] - da.min(axis=1) - db.min(axis=1)
    # a pair is found if either side reaches the other's cell, so half of the misses may be left to each
    return MultiIndex(a, b, float(np.quantile(beyond, 1 - (1 - recall) ** 0.5)) + 1e-9)


def traverse(da: np.ndarray, db: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells (i, j) in order of da[i] + db[j], by the multi-sequence walk, up to `reach` beyond the nearest."""
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    sa, sb = da[oa].tolist(), db[ob].tolist()
    most = sa[0] + sb[0] + reach
    heap, seen, out = [(sa[0] + sb[0], 0, 0)], {(0, 0)}, []
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > most:
            break
        out.append((int(oa[i]), int(ob[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(sa) and y < len(sb) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (sa[x] + sb[y], x, y))
    return out


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, first by their largest components, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """The column's vectors as rows of `width` components, filled up with zeros, at length one."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return _unit_rows(flat.reshape(len(column), width))
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return _unit_rows(out)


def _merge(q: np.ndarray, m: np.ndarray, n_q: int, n_m: int) -> list[tuple[int, int]]:
    """Of the hits (q[i], m[i]), a query number and a member number each, as few (label, node) links as join the same nodes;
    nodes are queries first, then members."""
    label = np.arange(n_q + n_m)
    m = m + n_q
    while True:
        before = label.copy()
        np.minimum.at(label, q, label[m])
        np.minimum.at(label, m, label[q])
        label = label[label]
        if (label == before).all():
            break
    nodes = np.unique(np.concatenate([q, m]))
    return [(int(label[x]), int(x)) for x in nodes if label[x] != x]


def _link_classes(classes: DataFrame, index: MultiIndex, cosine: float) -> DataFrame:
    """From classes (ck, label, mult, vec): rows (a, b, n), either a link a-b of a spanning forest (n null) or n more links of a (b null)."""
    held = classes.sparkSession.sparkContext.broadcast(index)
    n_second = len(index.second)
    width = index.first.shape[1] + index.second.shape[1]
    step = max(1, (1 << 20) // (len(index.first) + n_second))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        half = own.first.shape[1]
        for big in batches:
            for start in range(0, big.num_rows, min(step, 1000)):
                batch = big.slice(start, min(step, 1000))
                if not batch.num_rows:
                    continue
                x = _unit(batch.column(3), width)
                da, db = _squared(x[:, :half], own.first), _squared(x[:, half:], own.second)
                row, cell, kind = [], [], []
                home = da.argmin(axis=1) * n_second + db.argmin(axis=1)
                for i in range(len(x)):
                    visits = traverse(da[i], db[i], own.reach)
                    row += [i] * (1 + len(visits))
                    cell.append(int(home[i]))
                    kind.append(0)
                    cell += [a * n_second + b for a, b in visits]
                    kind += [1] * len(visits)
                row = pa.array(row, pa.int64())
                columns = [batch.column(c).take(row) for c in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(home, pa.int64()).take(row), pa.array(cell, pa.int64()), pa.array(kind, pa.int32())],
                    names=["ck", "label", "mult", "vec", "home", "cell", "kind"],
                )

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        half = own.first.shape[1]
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1), width)
                home = _nearest(x[:, :half], own.first) * n_second + _nearest(x[:, half:], own.second)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home, pa.int64())], names=["label", "cell"])

    vector = classes.schema["vec"].dataType.simpleString()
    dealt = classes.mapInArrow(assign, f"ck bigint, label string, mult bigint, vec {vector}, home bigint, cell bigint, kind int")
    cells = classes.select("label", "vec").mapInArrow(homes, "label string, cell bigint").groupBy("label", "cell").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / SMALL_BLOCK), F.lit(MOST_BLOCKS)), F.ceil(F.col("n") / BLOCK)).cast("int")
    large = cut(cells.where(F.col("n") > SMALL_BLOCK).select(F.col("label").alias("l"), F.col("cell").alias("c"), blocks.alias("blocks")), "cells")
    spread = dealt.join(large, (dealt["label"] == large["l"]) & (dealt["cell"] == large["c"]), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("ck"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = F.when(F.col("kind") == 0, F.transform(others, lambda o: mine * F.col("blocks") + o)).otherwise(F.transform(others, lambda o: o * F.col("blocks") + mine))
    spread = spread.withColumn("block", F.explode(tiles)).select("label", "cell", "block", "kind", "ck", "mult", "home", "vec")
    spread = spread.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "kind", "ck")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        half = own.first.shape[1]
        key, members, tables = None, [], None
        for big in batches:
            for start in range(0, big.num_rows, QUERIES):
                batch = big.slice(start, QUERIES)
                n = batch.num_rows
                label = np.array(batch.column(0).to_pylist(), object)
                cell, block = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                change = np.r_[True, (label[1:] != label[:-1]) | (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])]
                begins = np.flatnonzero(change)
                kind, ck, mult, home = (batch.column(c).to_numpy() for c in (3, 4, 5, 6))
                vec = _unit(batch.column(7), width) if n else None
                out_a, out_b, out_n = [], [], []
                for b, e in zip(begins, [*begins[1:], n], strict=True):
                    here = (label[b], cell[b], block[b])
                    if here != key:
                        key, members, tables = here, [], None
                    split = b + int(np.searchsorted(kind[b:e], 1))
                    if split > b:
                        members.append((ck[b:split], mult[b:split], home[b:split], vec[b:split]))
                        tables = None
                    if split == e or not members:
                        continue
                    if tables is None:
                        mck, mmult, _, mvec = (np.concatenate(x) for x in zip(*members, strict=True))
                        da, db = _squared(mvec[:, :half], own.first), _squared(mvec[:, half:], own.second)
                        tables = mck, mmult, mvec, da, db, da.min(axis=1) + db.min(axis=1) + own.reach
                    mck, mmult, mvec, da, db, most = tables
                    qck, qmult, qhome = ck[split:e], mult[split:e], home[split:e]
                    q, m = np.nonzero(vec[split:e] @ mvec.T >= cosine)
                    other = qck[q] != mck[m]
                    q, m = q[other], m[other]
                    if not len(q):
                        continue
                    # a member whose own traversal reaches the query's cell counts the link there
                    i, j = np.divmod(qhome[q], n_second)
                    back = da[m, i] + db[m, j] <= most[m]
                    for keys, sums in (
                        (qck, np.bincount(q, mmult[m], len(qck))),
                        (mck, np.bincount(m[~back], qmult[q[~back]], len(mck))),
                    ):
                        some = np.flatnonzero(sums)
                        out_a += keys[some].tolist()
                        out_b += [None] * len(some)
                        out_n += sums[some].astype(np.int64).tolist()
                    nodes = np.concatenate([qck, mck])
                    for x, y in _merge(q, m, len(qck), len(mck)):
                        out_a.append(int(nodes[x]))
                        out_b.append(int(nodes[y]))
                        out_n.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_a, out_b, out_n)], names=["a", "b", "n"])

    return spread.mapInArrow(compare, "a bigint, b bigint, n bigint")


def near_vectors(
    rows: DataFrame,
    cosine: float = 0.93,
    recall: float = 0.99,
    sample: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links join rows of one label whose cosine is at least `cosine`.

    Equal vectors of a label are one class with a multiplicity, so copies never multiply. Codebooks are fitted on `sample` classes
    (8 a code, if that is more); every class is indexed under its cell and visits the nearest cells by the multi-sequence walk;
    cosines are computed in double precision, from vectors kept in their own precision, and none below the limit is taken. Pairs
    are counted where they are found and leave the task only as counts and a spanning forest, so a dense group costs no rows. The
    grid grows with the largest label, so a cell holds a few classes at any size; a cell of very many (a dense group) is dealt in
    tiles of a block of members by a block of queries.

    A vector that is null, zero or has a null or non-finite component, a null label or a null id links with nothing: 0 links,
    itself as component, kept. Vectors of different lengths are never linked: length is part of the label, and lengths within a
    factor of two share an index, the shorter ones filled up with zeros. Rows equal in id, label and vector are linked
    to each other like any copies; other columns are not read; an empty table gives an empty result.
    """
    vector = F.col(vector_col)
    if vector_col in rows.columns and rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    fine &= F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    label = F.concat_ws(":", F.size(vector).cast("string"), F.col(label_col).cast("string"))
    slim = rows.select(F.col(id_col).alias("id"), F.when(fine, label).alias("label"), F.when(fine, vector).alias("v"))
    classes = (
        slim.where("label is not null").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("mult"))
    )
    classes = cut(classes.withColumn("ck", F.monotonically_increasing_id()), "classes")
    spark, found = rows.sparkSession, None
    band = F.ceil(F.log2(F.size("v"))).cast("int")  # lengths within a factor of two: as many plans at most as a length has bits
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("dim"), F.first(band).alias("band"))
    sizes = sizes.groupBy("band").agg(F.max("dim").alias("dim"), F.max("n").alias("n"), F.sum("n").alias("all"))
    for level, dim, largest, total in [tuple(r) for r in sizes.orderBy("band").collect()]:
        own, dim = classes.where(band == level), max(dim, 2)
        codes = max(2, math.ceil(math.sqrt(largest / 4)))
        wanted = max(sample, 8 * codes)
        share = F.pmod(F.xxhash64("least", "v"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.1 * wanted / total) * (1 << 30)))
        picked = [r["v"] for r in own.where(share).select("v").limit(wanted).toLocalIterator()] or [own.first()["v"]]
        filled = np.zeros((len(picked), dim))
        for i, v in enumerate(picked):
            filled[i, : len(v)] = v
        index = fit_index(_unit_rows(filled), codes, cosine, recall)
        part = _link_classes(own.select("ck", "label", "mult", F.col("v").alias("vec")), index, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    found = cut(found, "links")
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("n is null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    joined = cut(
        classes.join(counts, classes["ck"] == counts["a"], "left")
        .join(parts, classes["ck"] == parts["node"], "left")
        .select("label", "v", "least", "mult", F.coalesce("component", "ck").alias("component"), F.coalesce("n", F.lit(0)).alias("n")),
        "joined",
    )
    lowest = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    joined = joined.join(lowest, "component").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id")
    out = slim.join(joined, (slim["label"] == joined["l"]) & (slim["v"] == joined["w"]), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
