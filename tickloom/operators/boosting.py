"""Multiclass boosting: softmax gradients, histograms of binned features as Spark aggregates, trees chosen from the summed histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cuts import cut, drop_cuts


@dataclass
class Tree:
    """A node a place, children of i at 2 i + 1 and 2 i + 2: feature and the highest bin that goes left, or feature -1 and a value."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            left = bins[np.arange(len(bins)), np.maximum(f, 0)] <= self.bin[at]
            at = np.where(f < 0, at, 2 * at + 2 - left)
        return at


@dataclass
class SoftmaxModel:
    """classes: label values in order; edges: upper bounds of each feature's bins; rounds: a tree a class each; losses: of the validation rows, by round."""

    features: list[str]
    classes: list
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaves(bins)]
        return out

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bin 0 holds what is missing."""
        out = np.zeros(values.shape, np.uint8)
        for j, e in enumerate(self.edges):
            known = ~np.isnan(values[:, j])
            out[known, j] = 1 + np.searchsorted(e, values[known, j])
        return out


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(j).to_numpy(zero_copy_only=False), float) for j in range(n)]) if n else np.zeros((batch.num_rows, 0))


def train_softmax(
    df: DataFrame, features: Sequence[str], label: str, validation: str | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32,
    l2: float = 3.0, patience: int = 5, least: float = 1.0,
) -> SoftmaxModel:
    """Boosted trees with one softmax over all classes; validation: a boolean column of rows that are measured, not learnt from.

    Rows are binned by approximate quantiles (at most `bins` - 1 a feature and one for missing values) and written once. Each level of a round's
    trees is one Spark job: tasks sum gradients and curvatures by class, node, feature and bin in numpy, Spark adds them up, and the driver chooses
    splits from these sums, whose number depends on the parameters, not on rows. Training stops when the validation loss has not fallen for
    `patience` rounds, and the rounds after its least are dropped. Rows without a label go; fewer than two classes are an error.
    """
    known = df.where(F.col(label).isNotNull())
    classes = [r[0] for r in known.select(label).distinct().orderBy(label).limit(257).collect()]
    if not 2 <= len(classes) <= 256:
        raise ValueError(f"{len(classes)} classes: softmax needs 2 to 256")
    q = [i / (bins - 1) for i in range(1, bins - 1)]
    values = [F.col("`" + c.replace("`", "``") + "`").cast("double") for c in features]
    slim = known.select(
        *(F.when(~F.isnan(v), v).alias(f"x{j}") for j, v in enumerate(values)), F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)).cast("int").alias("y"),
        F.coalesce(F.col(validation), F.lit(False)).alias("valid") if validation else F.lit(False).alias("valid"),
    )
    edges = [np.unique(e) for e in slim.approxQuantile([f"x{j}" for j in range(len(features))], q, 0.2 / bins)]
    model = SoftmaxModel(list(features), classes, edges, np.zeros(len(classes)))
    d, K = len(features), len(classes)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model.binned(_matrix(batch, d))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(d, 1)), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(own).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(d), batch.column(d + 1)], names=["bins", "y", "valid"])

    rows = cut(slim.mapInArrow(bin_rows, "bins binary, y int, valid boolean"), "binned")
    shares = {r.y: r.n for r in rows.where("not valid").groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = np.array([shares.get(k + 1, 0) + 1.0 for k in range(K)])
    model.start = np.log(counts / counts.sum())

    def sums(trees: list[Tree] | None, level: int) -> tuple[np.ndarray, float, float]:
        """Gradients and curvatures (class, node, feature, bin, 2) of the level's nodes, and the validation rows' loss and number."""
        nodes, first = 1 << level, (1 << level) - 1

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, n = np.zeros((K, nodes, d, bins + 1, 2)), 0.0, 0.0
            for batch in batches:
                own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, d)
                y = batch.column(1).to_numpy() - 1
                valid = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                p = _softmax(model.raw(own))
                loss -= np.log(np.maximum(p[valid, y[valid]], 1e-15)).sum()
                n += valid.sum()
                own, y, p = own[~valid], y[~valid], p[~valid]
                for k in range(K):
                    at = trees[k].leaves(own) - first if trees else np.zeros(len(own), np.int64)
                    here = at >= 0  # a row that stopped at a leaf above takes no part
                    g, h = p[here, k] - (y[here] == k), np.maximum(p[here, k] * (1 - p[here, k]), 1e-12)
                    for j in range(d):
                        spot = at[here] * (bins + 1) + own[here, j]
                        for i, w in enumerate((g, h)):
                            total[k, :, j, :, i] += np.bincount(spot, w, nodes * (bins + 1)).reshape(nodes, bins + 1)
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[flat[at], loss, n])], names=["at", "v"])

        found = rows.mapInArrow(task, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        by = dict(zip(found["at"], found["v"], strict=True))
        flat = np.zeros(K * nodes * d * (bins + 1) * 2)
        inside = found["at"] >= 0
        flat[found["at"][inside]] = found["v"][inside]
        return flat.reshape(K, nodes, d, bins + 1, 2), by.get(-1, 0.0), by.get(-2, 0.0)

    def split(tree: Tree, total: np.ndarray, level: int) -> None:
        first = (1 << level) - 1
        for node in range(1 << level):
            at = first + node
            G, H = total[node, 0, :, 0].sum(), total[node, 0, :, 1].sum()
            tree.value[at] = -rate * G / (H + l2)
            if level == depth or H < 2 * least:
                continue
            left = total[node].cumsum(axis=1)[:, :-1]  # feature, highest bin on the left
            g, h = left[..., 0], left[..., 1]
            gain = g * g / (h + l2) + (G - g) ** 2 / (H - h + l2) - G * G / (H + l2)
            gain[(h < least) | (H - h < least)] = -np.inf
            j, b = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, b] > 1e-9:
                tree.feature[at], tree.bin[at] = j, b

    size, best = (1 << (depth + 1)) - 1, 0
    for turn in range(rounds + 1):
        total, loss, n = sums(None, 0)
        if n:
            model.losses.append(loss / n)
            if model.losses[turn] < model.losses[best] - 1e-12:
                best = turn
            if turn - best >= patience:
                break
        if turn == rounds or not d:
            break
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(K)]
        for level in range(depth + 1):
            if level:
                total = sums(trees, level)[0]
            for k, tree in enumerate(trees):
                split(tree, total[k], level)
        model.rounds.append(trees)
    if model.losses:
        model.rounds, model.losses = model.rounds[:best], model.losses[: best + 1]
    drop_cuts(rows)
    return model


def predict_softmax(model: SoftmaxModel, df: DataFrame, out: str = "probability", label_out: str = "prediction") -> DataFrame:
    """df with out, an array of the classes' probabilities in model.classes' order, and label_out, the likeliest class."""
    values = F.array(*(F.col("`" + c.replace("`", "``") + "`").cast("double") for c in model.features))
    d = len(model.features)

    @F.pandas_udf("array<double>")
    def score(x):
        import pandas as pd

        own = np.array([np.array(v, float) for v in x]).reshape(len(x), d)
        return pd.Series(list(_softmax(model.raw(model.binned(own)))))

    scored = df.withColumn(out, score(values))
    return scored.withColumn(label_out, F.array(*(F.lit(c) for c in model.classes))[(F.array_position(out, F.array_max(out)) - 1).cast("int")])
