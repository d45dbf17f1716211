"""Byte-level BPE over repeated text units: exact splits, two-generation caches, heap merging."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: The string that the vocabulary file holds as an added token: the library cuts texts there before all else.
SPECIAL = "<|endoftext|>"
#: White space as Unicode's White_Space property has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: tiktoken's regular expressions overflow their stack on white-space runs of about a million characters.
LONG_SPACE = 500_000
#: White space other than single blanks and line feeds between words.
_IRREGULAR = re.compile(r"[^\S \n]|[ \n](?:[ \n]|\Z)|\A[ \n]")


@lru_cache(1)
def pattern() -> regex.Pattern:
    """The pre-token pattern of the byte-level files, with white space spelled out."""
    import public_tokenizers

    text = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]")
    return regex.compile(text.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Recent(dict):
    """Values by string, made on demand. renewed() starts a new generation when this one is full, keeping the last at hand.
    limit: bytes, of which a key takes its characters and KEY_BYTES."""

    KEY_BYTES = 200

    def __init__(self, make: Callable, limit: int, old: dict | None = None):
        super().__init__()
        self.make, self.limit, self.old, self.held = make, limit, old or {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.add(key, value)
        return value

    def add(self, key: str, value) -> None:
        self[key] = value
        self.held += self.KEY_BYTES + len(key)

    def renewed(self) -> Recent:
        if self.held <= self.limit:
            return self
        self.old = {}
        return Recent(self.make, self.limit, self)


class TextUnits:
    """Folds a text's pre-tokens with values cached by unit.

    A text whose white space is single blanks and line feeds between words is cut at these: the pattern starts a pre-token
    at each of them, so a unit's pre-tokens do not depend on its neighbours. Any other text goes through the pattern whole.
    Values are folded, as by a sum.
    """

    def __init__(self, value: Callable, fold: Callable, special, limit: int = 40 << 20):
        self.words = Recent(value, limit)
        self.fold, self.special = fold, special
        self.units = Recent(self._unit, limit)

    def _whole(self, text: str):
        return self.fold(map(self.words.__getitem__, pattern().findall(text)))

    def _unit(self, unit: str):
        # "\r" marks the unit at a text's start, "\n" one after a line feed; others follow a blank
        return self._whole(unit[1:] if unit[0] == "\r" else unit if unit[0] == "\n" else " " + unit)

    def renew(self) -> None:
        self.words, self.units = self.words.renewed(), self.units.renewed()

    def plain(self, text: str):
        if not text:
            return self.fold(())
        if _IRREGULAR.search(text):
            return self._whole(text)
        units = text.replace("\n", " \n").split(" ")
        units[0] = "\r" + units[0]
        return self.fold(map(self.units.__getitem__, units))

    def of(self, text: str):
        if SPECIAL not in text:
            return self.plain(text)
        parts = text.split(SPECIAL)
        folded = [self.plain(parts[0])]
        for part in parts[1:]:
            folded += [self.special, self.plain(part)]
        return self.fold(folded)


@lru_cache(1)
def byte_chars() -> str:
    """The character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return "".join(out)


@lru_cache(2)
def rank_encoding(path: str):
    """A tiktoken encoding with the file's own ids: in a vocabulary made by merging, ids after the bytes follow the merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary = file["model"]["vocab"]
    special = next((t["id"] for t in file["added_tokens"] if t["content"] == SPECIAL), None)
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if token != SPECIAL}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(1)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def longest_space(text: str) -> int:
    """Characters of the longest white-space run: one linear scan, of texts over LONG_SPACE characters only."""
    return max((m.end() - m.start() for m in re.finditer(r"\s+", text)), default=0) if len(text) > LONG_SPACE else 0


def id_encoder(path: str, dtype: str = "<u4") -> Callable[[str], bytes]:
    """A function from a text to its ids by the byte-level BPE .json file at `path`, as bytes of `dtype`, without added tokens.

    Ids are those of the tokenizers library: made by tiktoken from the file's own ranks, which takes a fifth of the time (the
    tests hold the two equal), and by the library itself for texts with a white-space run of over LONG_SPACE characters."""
    encoding, special = rank_encoding(path)

    def wide(text: str) -> bytes:
        if longest_space(text) > LONG_SPACE:
            return np.array(library_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype).tobytes()
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(dtype, copy=False).tobytes()

    if special is None:
        return wide
    mark = np.array([special], dtype).tobytes()
    return lambda text: mark.join(map(wide, text.split(SPECIAL))) if SPECIAL in text else wide(text)  # the library cuts there first


@lru_cache(2)
def merge_ranks(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}


def heap_token_count(piece: str, ranks: dict[tuple[str, str], int]) -> int:
    """Tokens of one pre-token: its bytes less the merges made.

    The symbols are a linked list over byte positions; the heap holds adjacent pairs as rank * bytes + position. A popped pair is
    stale, and skipped, if the rank of the pair at its position has changed since (a rank names one pair of symbols); else its
    right symbol joins the left one and the pairs to both sides enter the heap. n bytes make at most 3n pushes, so a piece takes
    O(n log n) and about 70 bytes of memory a byte.
    """
    symbols = piece.encode("utf-8").decode("latin-1").translate(byte_chars())
    n = len(symbols)
    after, before, current = array("i", range(1, n + 1)), array("i", range(-1, n)), array("i", [-1]) * n
    heap = []
    for i in range(n - 1):
        r = ranks.get((symbols[i], symbols[i + 1]))
        if r is not None:
            current[i] = r
            heap.append(r * n + i)
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if current[i] != r:
            continue
        mid = after[i]
        after[i] = end = after[mid]
        current[mid] = current[i] = -1
        merges += 1
        if end < n:
            before[end] = i
            r = ranks.get((symbols[i:end], symbols[end : after[end]]))
            if r is not None:
                current[i] = r
                heapq.heappush(heap, r * n + i)
        if (p := before[i]) >= 0:
            r = ranks.get((symbols[p:i], symbols[i:end]))
            current[p] = -1 if r is None else r
            if r is not None:
                heapq.heappush(heap, r * n + p)
    return n - merges
