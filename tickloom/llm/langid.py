"""Language ID by unigram pieces of a public vocabulary, marginalised over all segmentations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import char_matrix, distinct_sample, substring_hashes
from .shared import docs_in

_OTHER = regex.compile(r"\P{L}+")  # what str.isalpha denies
START = "▁"  # marks a word's start in the vocabulary
FLOOR = 1e-9  # probability of a character that no piece holds
WIDE = 32  # longer words are summed one by one with rescaling, since their probabilities leave the range of doubles
ROWS = 1 << 16  # characters of a long word hashed at a time


@dataclass(frozen=True)
class LanguageModel:
    """languages; keys: sorted hashes of the pieces; prob[piece, language], the last row for what is no piece; longest piece."""

    languages: list[str]
    keys: np.ndarray
    prob: np.ndarray
    longest: int


def vocabulary_pieces(path: str) -> list[str]:
    """The letter pieces, in lower case, of a sentencepiece model: all of them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p and p.lstrip(START).isalpha() and START not in p[1:])


def words_of(token: str) -> list[str]:
    """The marked words of one blank-separated token in lower case: letters only, whole."""
    return [START + word for word in _OTHER.sub(" ", token).split()]


def _piece_ids(chars: np.ndarray, model_keys: np.ndarray, longest: int) -> list[np.ndarray]:
    """Like substring_hashes, but the place of each piece in model_keys, or len(model_keys)."""
    out, n = [], len(model_keys)
    for h in substring_hashes(chars, longest):
        at = np.searchsorted(model_keys, h)
        out.append(np.where(model_keys[np.minimum(at, n - 1)] == h, at, n))
    return out


def _forward(ids: list[np.ndarray], prob: np.ndarray, width: int) -> list[np.ndarray]:
    """alpha[j]: probability of the first j characters, summed over all segmentations; one row a word, one column a language."""
    n = len(ids[0])
    alpha = [np.ones((n, prob.shape[1]))]
    for j in range(1, width + 1):
        total = alpha[j - 1] * np.maximum(prob[ids[0][:, j - 1]], FLOOR)
        for m in range(2, min(len(ids), j) + 1):
            total += alpha[j - m] * prob[ids[m - 1][:, j - m]]
        alpha.append(total)
    return alpha


def _long_score(word: str, model: LanguageModel) -> np.ndarray:
    """_forward's last row in logarithms for a word of any length: the sums of the last few places are kept, and rescaled by the
    best language's at each place. Time and memory: linear, and bounded by the longest piece."""
    keep, scale = model.longest, np.zeros(len(model.languages))
    last = np.zeros((keep, len(model.languages)))  # of the places before, the latest first
    last[0] = 1.0
    for begin in range(0, len(word), ROWS):
        here = max(0, begin - keep + 1)  # pieces that end in this part may start before it
        part = char_matrix([word[here : begin + ROWS]])
        ids = _piece_ids(part, model.keys, keep)
        for j in range(begin, min(begin + ROWS, len(word))):
            most = min(keep, j + 1, len(ids))
            prob = model.prob[[ids[m][0, j - m - here] for m in range(most)]]
            prob[0] = np.maximum(prob[0], FLOOR)
            total = (last[:most] * prob).sum(axis=0)
            last[1:] = last[:-1]
            last[0] = total
            scale += np.log(total)
            last /= total
    return scale


def word_scores(words: list[str], model: LanguageModel) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), len(model.languages)))
    if not model.languages:
        return out
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes[sizes <= WIDE]):
        at = np.flatnonzero(sizes == size)
        ids = _piece_ids(char_matrix([words[i] for i in at]), model.keys, model.longest)
        out[at] = np.log(_forward(ids, model.prob, int(size))[-1])
    for i in np.flatnonzero(sizes > WIDE):
        out[i] = _long_score(words[i], model)
    return out


def fit_languages(counts: dict[str, Counter], pieces: list[str], rounds: int = 3) -> LanguageModel:
    """Piece probabilities by expectation-maximisation over word counts per language (rounds of forward and backward sums). Words of
    over WIDE characters, whose sums leave the range of doubles, are scored but not learnt from."""
    languages, longest = sorted(counts), max(map(len, pieces))
    keys = np.empty(len(pieces), np.uint64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        keys[at] = substring_hashes(char_matrix([pieces[i] for i in at]), int(size))[-1][:, 0]
    keys = np.unique(keys)
    prob = np.zeros((len(keys) + 1, len(languages)))
    for g, language in enumerate(languages):
        groups: dict[int, list[str]] = {}
        for word in counts[language]:
            if len(word) <= WIDE:
                groups.setdefault(len(word), []).append(word)
        ready = [
            (size, _piece_ids(char_matrix(words), keys, longest), np.array([counts[language][w] for w in words], float))
            for size, words in groups.items()
        ]
        own = np.zeros(len(keys) + 1)
        for _, ids, n in ready:  # start: how often a piece occurs at all
            for m, at in enumerate(ids):
                np.add.at(own, at, n[:, None] / (m + 1))
        for step in range(rounds + 1):
            own[-1] = 0
            own = (own + 1e-3) / (own + 1e-3).sum()
            own[-1] = 0
            if step == rounds:
                break
            p, fresh = own[:, None], np.zeros(len(keys) + 1)
            for size, ids, n in ready:
                alpha = _forward(ids, p, size)
                beta = [None] * size + [np.ones((len(n), 1))]
                for i in range(size - 1, -1, -1):
                    total = beta[i + 1] * np.maximum(p[ids[0][:, i]], FLOOR)
                    for m in range(2, min(len(ids), size - i) + 1):
                        total += beta[i + m] * p[ids[m - 1][:, i]]
                    beta[i] = total
                whole = (n / alpha[-1][:, 0])[:, None]
                for m, at in enumerate(ids):
                    for i in range(at.shape[1]):
                        np.add.at(fresh, at[:, i], (alpha[i] * p[at[:, i]] * beta[i + m + 1] * whole)[:, 0])
            own = fresh
        prob[:, g] = own
    return LanguageModel(languages, keys, prob, longest)


def train_languages(docs: DataFrame, vocabulary: str, per_language: int = 300, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fitted on at most per_language different texts a language (lowest CRC-32), whole, with all their words; rows with a null text
    or language are left out."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts: dict[str, Counter] = {}
    for row in distinct_sample(rows, "lang", per_language).toLocalIterator():
        mine = counts.setdefault(row["lang"], Counter())
        for token, n in Counter(row["text"].lower().split()).items():
            for word in words_of(token):
                mine[word] += n
    counts = {k: c for k, c in counts.items() if c}
    if not counts:
        return LanguageModel([], np.zeros(0, np.uint64), np.zeros((1, 0)), 1)
    return fit_languages(counts, vocabulary_pieces(vocabulary))


class _Tokens:
    """Scores and letters of tokens seen lately, by token, in bounded memory."""

    def __init__(self, model: LanguageModel, limit: int = 60 << 20):
        self.model, self.limit = model, limit
        self.clear()

    def full(self) -> bool:
        """Whether keys (each its characters and 200 bytes) and scores take more than limit bytes."""
        return self.held + self.scores.nbytes > self.limit

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((1024, len(self.model.languages)))
        self.letters = np.zeros(1024)

    def places(self, tokens: list[str]) -> np.ndarray:
        fresh = [t for t in dict.fromkeys(tokens) if t not in self.at]
        if fresh:
            begin, end = len(self.at), len(self.at) + len(fresh)
            while end > len(self.letters):
                self.scores, self.letters = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
            owner, words = [], []
            for k, token in enumerate(fresh):
                for word in words_of(token):
                    owner.append(k)
                    words.append(word)
            if words:
                owner = np.array(owner)
                found = word_scores(words, self.model)
                for g in range(found.shape[1]):
                    self.scores[begin:end, g] = np.bincount(owner, found[:, g], len(fresh))
                self.letters[begin:end] = np.bincount(owner, [len(w) for w in words], len(fresh))
            self.at.update(zip(fresh, range(begin, end), strict=True))
            self.held += sum(map(len, fresh)) + 200 * len(fresh)
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))


def detect_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", evidence: int = 40) -> DataFrame:
    """(id, lang_pred, score) for each row of docs, from its whole text.

    A word's probability in a language is the sum over all its segmentations into pieces; a text's is the product over its
    words; letters are those of str.isalpha. The prediction is the language of the highest product over the whole text. score: the
    posterior at equal priors of the mean evidence a character times at most `evidence` characters, a calibration that keeps
    the score of a long mixed text from 1. `und` with score 0 if the text is null or has no letter, or the model no language; ties go to
    the first language in order. A null id stays null; repeated rows give repeated rows; other columns are not read; an empty
    table gives an empty result. One narrow pass, no shuffle; the model (a few MB, bounded by the vocabulary) goes with the tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        tokens, names = _Tokens(own), own.languages
        for batch, texts in docs_in(batches, 1, 1 << 20):
            n = len(texts)
            split = [t.lower().split() if t else [] for t in texts]
            doc = np.repeat(np.arange(n), [len(s) for s in split])
            at = tokens.places([w for s in split for w in s])
            letters = np.bincount(doc, tokens.letters[at], n)
            pred, score = np.full(n, "und", object), np.zeros(n)
            if names:
                total = np.stack([np.bincount(doc, tokens.scores[at, g], n) for g in range(len(names))], axis=1)
                z = total / np.maximum(letters, 1)[:, None] * np.minimum(letters, evidence)[:, None]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                best = z.argmax(axis=1)
                known = letters > 0
                pred[known] = np.array(names, object)[best[known]]
                score[known] = (z[np.arange(n), best] / z.sum(axis=1))[known]
            if tokens.full():
                tokens.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)
