"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Recent
from .ngrams import bounded_sample, char_matrix, distinct_sample, substring_hashes
from .shared import cut, docs_in

LONGEST_WORD = 32  # characters; longer words are taken in consecutive parts
SIZES = range(3, 7)  # characters of a subword


@dataclass(frozen=True)
class ToxicityModel:
    """weight: each bucket's vector times the softmax's weight difference; score = sigmoid(scale * mean word weight + shift)."""

    weight: np.ndarray
    scale: float
    shift: float


def _parts(token: str) -> list[str]:
    word = "".join(c if c.isalpha() else " " for c in token)
    return [w[i : i + LONGEST_WORD] for w in word.split() for i in range(0, len(w), LONGEST_WORD)]


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each subword of <word>: its 3 to 6 character substrings and itself."""
    owner, bucket = [], []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        hashes = substring_hashes(char_matrix([f"<{words[i]}>" for i in at]), int(size) + 2)
        for m in sorted({*SIZES, int(size) + 2}):
            if m <= size + 2:
                h = hashes[m - 1] * np.uint64(0x9E3779B97F4A7C15)
                owner.append(np.repeat(at, h.shape[1]))
                bucket.append((h >> shift).astype(np.int64).ravel())
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def fit_toxicity(
    bags: list[dict[str, int]], labels: np.ndarray, prior: float, buckets: int = 1 << 17, dim: int = 6, epochs: int = 120, seed: int = 7, z_least: float = 3.0, cut_score: float = 0.7
) -> ToxicityModel:
    """Vectors and softmax together by Adam on whole batches of word bags.

    prior: share of label 1 in the corpus, to which the calibration is weighted. Only subwords whose share of bags differs
    between the labels by z_least standard errors (of the log ratio) get vectors, so the rest cannot be learnt by heart.
    """
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(buckets, np.float32), 0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    rng = np.random.default_rng(seed)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for b in bags for w in b))}
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    word = np.fromiter((vocab[w] for b in bags for w in b), np.int64, len(doc))
    count = np.fromiter((n for b in bags for n in b.values()), float, len(doc))
    share = (count / np.maximum(np.bincount(doc, count, len(bags)), 1)[doc]).astype(np.float32)
    owner, bucket = subwords(list(vocab), buckets)
    y = labels.astype(np.float32)
    begins = np.searchsorted(owner, np.arange(len(vocab) + 1))
    ones, zeros = np.full(buckets, 0.5), np.full(buckets, 0.5)
    edges = np.searchsorted(doc, np.arange(len(bags) + 1))
    for d in range(len(bags)):  # in how many bags of each label a subword is
        words = word[edges[d] : edges[d + 1]]
        found = np.unique(np.concatenate([bucket[begins[w] : begins[w + 1]] for w in words])) if len(words) else words
        (ones if y[d] else zeros)[found] += 1
    all_ones, all_zeros = y.sum() + 1, (1 - y).sum() + 1
    ratio = np.log(ones / all_ones) - np.log(zeros / all_zeros)
    often = np.abs(ratio) >= z_least * np.sqrt(1 / ones + 1 / zeros)
    size = np.maximum(np.bincount(owner, minlength=len(vocab)), 1).astype(np.float32)
    use = often[bucket]
    owner, bucket = owner[use], bucket[use]
    live, bucket = np.unique(bucket, return_inverse=True)
    part = 1 / size[owner]
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    E = rng.normal(0, 0.1, (dim, len(live))).astype(np.float32)
    W = rng.normal(0, 0.5, dim).astype(np.float32)  # the difference of the softmax's two rows
    b, gain = np.float32(0), np.float32(50)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        words = np.stack([np.bincount(owner, e[bucket] * part, len(vocab)) for e in E])
        bag = np.stack([np.bincount(doc, v[word] * share, len(bags)) for v in words])
        return bag, gain * (W @ bag) + b

    state = [[np.zeros_like(E), np.zeros_like(E)], [np.zeros_like(W), np.zeros_like(W)]]
    for t in range(1, epochs + 1):
        bag, z = forward()
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        gW = gain * (bag @ d) + 1e-4 * W
        back = np.bincount(word, share * d[doc], len(vocab))
        shared = np.bincount(bucket, back[owner] * part, len(live))
        gE = (gain * W[:, None] * shared[None, :] + 1e-7 * E).astype(np.float32)
        b -= np.float32(0.5 * d.sum())
        for x, g, s, rate in ((E, gE, state[0], 0.05), (W, gW, state[1], 0.05)):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= (rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-9)).astype(x.dtype)
    weight = np.zeros(buckets, np.float32)
    weight[live] = W @ E
    mean = np.bincount(doc, np.bincount(owner, weight[live][bucket] * part, len(vocab))[word] * share, len(bags))
    each = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    spread = max(float(mean.std()), 1e-9)
    u, a, c = mean / spread, 1.0, 0.0
    for _ in range(100):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * u + c, -30, 30)))
        g = np.array([(each * (p - y) * u).sum() + 1e-3 * a, (each * (p - y)).sum()])
        v = each * p * (1 - p) + 1e-9
        H = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(H, g)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    a = max(a, 1e-3)
    # the cut with the best F1 at the corpus's share of label 1 scores `cut_score`
    order = np.argsort(-u, kind="stable")
    hit, all_hits = np.cumsum((each * y)[order]), max(float((each * y).sum()), 1e-12)
    f1 = 2 * hit / (np.cumsum(each[order]) + all_hits)
    falls = np.flatnonzero(u[order][:-1] > u[order][1:])  # a cut lies between two values
    if len(falls):
        best = falls[f1[falls].argmax()]
        at = (u[order][best] + u[order][best + 1]) / 2
        c = float(np.log(cut_score / (1 - cut_score)) - a * at)
    else:
        c = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    return ToxicityModel(weight, a / spread, c)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = 1200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[DataFrame, float]:
    """((id, text, label) of at most per_class documents of each label, those of lowest CRC-32; share of label 1 of all labelled).

    Only ids and checksums meet the labels by a shuffle; texts are then fetched by the sample, a broadcast of at most
    2 * per_class rows. Null ids, texts and labels are left out; of rows with texts equal by CRC-32, one id stands for all.
    """
    key = F.crc32(F.col(text_col).cast("string"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    slim = cut(docs.select(F.col(id_col).alias("id"), key.alias("key")).where("key is not null").join(marks, "id"), "labelled")
    counts = {r["y"]: r["n"] for r in slim.groupBy("y").agg(F.count("*").alias("n")).collect()}
    once = slim.groupBy("y", "key").agg(F.min("id").alias("id"))  # copies fill no class
    picked = bounded_sample(once, "y", per_class, F.col("key"))
    picked = picked.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("y").alias("__y"))
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), key.alias("__own"))
    found = texts.join(F.broadcast(picked), (F.col(id_col) == F.col("__id")) & (F.col("__own") == F.col("__key")))
    found = found.select(id_col, text_col, F.col("__y").alias(label_col))
    return cut(found, "sample"), counts.get(1, 0) / max(1, sum(counts.values()))


def train_toxicity(
    labelled: DataFrame, per_class: int = 1200, text_col: str = "text", label_col: str = "toxic", prior: float | None = None, **options
) -> ToxicityModel:
    """Fitted on at most per_class different texts of each label (lowest CRC-32), whole texts; null texts and labels are left out.
    prior: share of label 1 in the corpus, that of `labelled` if not given."""
    rows = labelled.select(F.col(label_col).cast("int").alias("y"), F.col(text_col).cast("string").alias("text")).where("y in (0, 1) and text is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bags, labels = [], []
    for row in distinct_sample(rows, "y", per_class).toLocalIterator():
        bag: Counter = Counter()
        for token, n in Counter(row["text"].lower().split()).items():
            for word in _parts(token):
                bag[word] += n
        if bag:
            bags.append(bag)
            labels.append(row["y"])
    if prior is None:
        prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_toxicity(bags, np.array(labels), prior, **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row of docs: the mean over all words of the text, each the mean of its subwords' weights.

    A null text counts as empty; a text without words gets the score of a zero mean; a null id stays null; repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty result. One narrow pass, no shuffle; the model is
    bounded by its buckets and goes with the tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        known = Recent(lambda token: None, 60 << 20)

        def learn(tokens: set[str]) -> None:
            fresh = []
            for token in tokens:
                if token not in known:
                    value = known.old.get(token)
                    if value is None:
                        fresh.append(token)
                    else:
                        known.add(token, value)
            owner, words = [], []
            for k, token in enumerate(fresh):
                for word in _parts(token):
                    owner.append(k)
                    words.append(word)
            sums, sizes = np.zeros(len(fresh)), np.bincount(owner, minlength=len(fresh)) if owner else np.zeros(len(fresh))
            if words:
                at, bucket = subwords(words, len(own.weight))
                means = np.bincount(at, own.weight[bucket], len(words)) / np.maximum(np.bincount(at, minlength=len(words)), 1)
                sums = np.bincount(owner, means, len(fresh))
            for token, value in zip(fresh, zip(sums.tolist(), sizes.tolist(), strict=True), strict=True):
                known.add(token, value)

        for batch, texts in docs_in(batches, 1, 1 << 20):
            split = [t.lower().split() if t else [] for t in texts]
            learn({w for s in split for w in s})
            flat = np.array([known[w] for s in split for w in s]).reshape(-1, 2)
            doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
            words = np.bincount(doc, flat[:, 1], len(texts))
            mean = np.bincount(doc, flat[:, 0], len(texts)) / np.maximum(words, 1)
            score = 1 / (1 + np.exp(-np.clip(own.scale * mean + own.shift, -700, 700)))
            known = known.renewed()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
