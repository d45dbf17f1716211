"""Quality rules: base counts and repetition from a suffix array over each document's words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import docs_in, map_batches, quoted

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True


@dataclass(frozen=True)
class QualityRules:
    """min_words and max_repeat_pct are the base rules. Of the repeats of at least min_repeat words, the covered share of the
    words and the longest one are limited."""

    min_words: int = 50
    max_repeat_pct: int = 50
    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: int = 100


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def suffix_repeats(words: np.ndarray, doc: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the word ids: whether the 3-word window there occurs twice or more in its document; the length of the
    longest repeat that starts there if it has min_repeat words (else 0). doc: ascending document numbers of the places.

    Prefix doubling sorts the suffixes of each document: after round k, suffixes are ranked by 2^k words, and only those
    that still share a rank are sorted again. The ranks of all rounds give the common prefix of neighbours in the suffix
    array; the larger one of a suffix's two neighbours is the depth of its deepest longest-common-prefix interval.
    """
    n = len(words)
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    place = np.arange(n)
    end = np.searchsorted(doc, doc, "right")  # the place after each document
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)  # the ranks of all rounds are held, 4 bytes a word and round
    ordered = key[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.maximum.accumulate(np.where(first, place, 0))
    rank[order] = starts
    sizes = np.diff(np.r_[np.flatnonzero(first), n])
    active = order[np.repeat(sizes > 1, sizes)]  # in suffix order, equal ranks adjacent
    ranks, step, three = [rank], 1, np.zeros(n, bool)
    while len(active):
        last = ranks[-1]
        ahead = active + step
        inside = ahead < end[active]
        nxt = np.where(inside, last[np.minimum(ahead, n - 1)] + np.int32(1), np.int32(0))
        own = last[active]
        sort = np.lexsort((nxt, own))
        active, own, nxt = active[sort], own[sort], nxt[sort]
        m = len(active)
        fresh_group = np.r_[True, own[1:] != own[:-1]]
        fresh = fresh_group | np.r_[True, nxt[1:] != nxt[:-1]]
        at = np.arange(m)
        group_at = np.maximum.accumulate(np.where(fresh_group, at, 0))
        sub_at = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = last.copy()
        rank[active] = own + (sub_at - group_at)
        ranks.append(rank)
        sub_sizes = np.diff(np.r_[np.flatnonzero(fresh), m])
        active = active[np.repeat(sub_sizes > 1, sub_sizes)]
        step *= 2  # suffixes that end within the compared words are told apart by their ends: equal ranks are whole prefixes
        if len(ranks) == 2:  # ranks of two words: add the third
            two = active[active + 3 <= end[active]]
            if len(two):
                pair = rank[two].astype(np.int64) * (n + 1) + ranks[0][two + 2]
                _, where, count = np.unique(pair, return_inverse=True, return_counts=True)
                three[two[count[where] > 1]] = True
    longest = np.zeros(n, np.int64)
    level = max(0, min_repeat.bit_length() - 1)
    if level < len(ranks):
        base = ranks[level]
        some = np.flatnonzero(np.bincount(base, minlength=n)[base] > 1)
        if len(some):
            array = some[np.argsort(ranks[-1][some], kind="stable")]
            a, b = array[:-1].copy(), array[1:].copy()
            common, same = np.zeros(len(a), np.int64), doc[a] == doc[b]
            ea, eb = end[a], end[b]
            for k in range(len(ranks) - 1, -1, -1):
                size = 1 << k
                fits = same & (a + size <= ea) & (b + size <= eb)
                equal = fits & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
                common += np.where(equal, size, 0)
                a, b = np.where(equal, a + size, a), np.where(equal, b + size, b)
            deep = np.maximum(np.r_[0, common], np.r_[common, 0])
            longest[array] = np.where(deep >= min_repeat, deep, 0)
    return three, longest


def measure(texts: list[bytes | None], rules: QualityRules) -> dict[str, np.ndarray]:
    """The columns of score_quality for some documents' UTF-8 bytes."""
    ids, counts, flat = _Ids(), [], []
    n = len(texts)
    chars, symbols, dup_lines = (np.zeros(n, np.int64) for _ in range(3))
    for i, text in enumerate(texts):
        words = text.split() if text else []
        counts.append(len(words))
        flat += map(ids.__getitem__, words)
        if words:
            data = np.frombuffer(text, np.uint8)
            chars[i] = np.count_nonzero(((data & 0xC0) != 0x80) & ~_BLANK[data])
            symbols[i] = np.count_nonzero(_SYMBOLS[data])
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            dup_lines[i] = len(lines) - len(set(lines))
    counts = np.array(counts, np.int64)
    total = len(flat)
    doc = np.repeat(np.arange(n), counts)
    three, longest = suffix_repeats(np.array(flat, np.int64), doc, rules.min_repeat)
    at = np.flatnonzero(three)
    in_three = np.zeros(total, bool)
    for d in range(3):
        in_three[at + d] = True
    at = np.flatnonzero(longest)
    reach = np.bincount(at, minlength=total + 1)[: total + 1] - np.bincount(at + longest[at], minlength=total + 1)[: total + 1]
    covered = np.cumsum(reach[:total]) > 0
    per_doc = lambda v: np.bincount(doc, v, n).astype(np.int64)
    repeat_words, covered_words = per_doc(in_three), per_doc(covered)
    longest_repeat = np.zeros(n, np.int64)
    np.maximum.at(longest_repeat, doc[at], longest[at])
    base_failed = (counts < rules.min_words) | (100 * repeat_words > rules.max_repeat_pct * counts)
    share = covered_words / np.maximum(counts, 1)
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "covered_words": covered_words,
        "longest_repeat": longest_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (share <= rules.max_covered) & (longest_repeat <= rules.max_longest),
    }


COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)


def score_quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, covered_words, longest_repeat, base_failed, kept) for each row of docs, from its whole text.

    One narrow pass, no shuffle; a task holds a few MB of texts at a time, or one longer text; its suffix array takes 4 bytes a
    word for each doubling of the longest repeat (4 MB of one repeated word, 2 million words: about 250 MB). A null or empty text has no
    words and so fails the base rules; a null id stays null; repeated rows give repeated rows; other columns are not read;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in docs_in(batches, 1, 1 << 20, binary=True):
            found = measure(texts, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], names=["id", *found])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("t")).mapInArrow(run, f"id {kind}, {COLUMNS}")
    return scored.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and no others; nulls and empty texts are rejected."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in docs_in(batches, at, 1 << 20, binary=True):
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(measure(texts, rules)["kept"])).columns, names=names)

    return map_batches(docs, run, docs.schema)
