"""Line dedup by content-defined chunks of lines: byte comparison, growth of each match line by line, first occurrence stays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, docs_in, drop_cuts, map_batches, may_hold, quoted

_ODD = 0x9E3779B97F4A7C15  # multiplier of the rolling hash, any odd 64-bit number
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class ChunkRules:
    """A boundary follows a line where the rolling hash of the last `window` line hashes is higher than at its two neighbours, so
    chunks have two lines at least, about three on average, and a line put in anywhere moves only the boundaries next to it. A
    line of min_words words or more is a chunk of its own. Chunks of two or more lines with words, or of min_words words, are
    compared."""

    window: int = 2
    min_words: int = 50


def line_chunks(text: bytes, rules: ChunkRules) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether the chunk is compared) of each chunk, in order."""
    lines = text.split(b"\n")
    counts = [len(line.split()) for line in lines]
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    top, rolling, rolled = pow(_ODD, rules.window, 1 << 64), 0, [-1]
    for i, h in enumerate(hashes):
        rolling = (rolling * _ODD + h) & _MASK
        if i >= rules.window:
            rolling = (rolling - hashes[i - rules.window] * top) & _MASK
        rolled.append(rolling)
    rolled.append(-1)
    out, begin, full, words = [], 0, 0, 0
    for i, n in enumerate(counts):
        own = n >= rules.min_words
        if own and begin < i:
            out.append((begin, i, full > 1 or words >= rules.min_words))
            begin, full, words = i, 0, 0
        full += n > 0
        words += n
        if own or rolled[i] < rolled[i + 1] >= rolled[i + 2] or i == len(lines) - 1:
            out.append((begin, i + 1, full > 1 or words >= rules.min_words))
            begin, full, words = i + 1, 0, 0
    return out


def _worded(lines: list[bytes]) -> list[bool]:
    return [bool(line) and not line.isspace() for line in lines]


def compared_chunks(text: bytes, rules: ChunkRules, trim: bool) -> list[tuple[int, int, int, int]]:
    """(first line, line after the last, first line of the chunk before, line after the last of the chunk after) of each chunk that is
    compared. trim: without blank lines at the chunk's own ends."""
    chunks, out = line_chunks(text, rules), []
    full = _worded(text.split(b"\n")) if trim else []
    for k, (a, b, compared) in enumerate(chunks):
        if compared:
            low, high = chunks[max(k - 1, 0)][0], chunks[min(k + 1, len(chunks) - 1)][1]
            while trim and not full[a]:
                a += 1
            while trim and not full[b - 1]:
                b -= 1
            out.append((a, b, low, high))
    return out


def grown(own: bytes | None, first: bytes | None, step: int) -> int:
    """How many lines next to a repeated chunk equal those next to its first place, up to the last of them with words. step: 1 for the
    lines after it, -1 for those before it, nearest last."""
    if own is None or first is None:
        return 0
    n = 0
    for k, (x, y) in enumerate(zip(own.split(b"\n")[::step], first.split(b"\n")[::step], strict=False)):
        if x != y:
            break
        if x and not x.isspace():
            n = k + 1
    return n


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 1) - (1 << 63)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))


def _hashes(slim: DataFrame, rules: ChunkRules, trim: bool) -> DataFrame:
    """(id, th, starts, hashes, worded, pairs) a document: hashes of its compared chunks by their first lines; with trim, its lines with
    words and a hash for each two that follow each other, what is blank between them included."""
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in docs_in(batches, 2, 2 << 20, binary=True):
            starts, hashes, worded, pairs = [], [], [], []
            for text in texts:
                lines = text.split(b"\n")
                found = compared_chunks(text, rules, trim)
                starts.append([a for a, *_ in found])
                hashes.append([_hash(b"\n".join(lines[a:b])) for a, b, *_ in found])
                full = [i for i, worded_line in enumerate(_worded(lines)) if worded_line] if trim else []
                worded.append(full)
                pairs.append([_hash(b"\n".join(lines[i : j + 1])) for i, j in zip(full, full[1:], strict=False)])
            columns = [pa.array(x, pa.list_(k)) for x, k in ((starts, pa.int32()), (hashes, pa.int64()), (worded, pa.int32()), (pairs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "th", "starts", "hashes", "worded", "pairs"])

    held = slim.where(F.col("t").contains("\n") | (F.length("t") >= 2 * rules.min_words - 1))
    return held.mapInArrow(run, f"id {kind}, th bigint, starts array<int>, hashes array<bigint>, worded array<int>, pairs array<bigint>")


def _repeated_runs(slim: DataFrame, hashed: DataFrame, run, grow: bool) -> DataFrame:
    """(id, th, runs) of the documents that hold spans which an earlier place equals byte for byte; runs: (first line, line after the last).

    hashed: (id, th, a, h), a span's first line and hash. Only spans whose hash repeats are read again from the texts, by `run`, which maps
    (text, first lines) to (a, b, bytes, lines before, lines after); their bytes are grouped, which is the comparison. grow: a repeated span
    takes the lines next to it that equal those at the first place."""
    kind = slim.schema["id"].dataType.simpleString()
    # written: a join whose sides are plain shuffles can be split where one hash is hot, one with an aggregate in it cannot
    repeated = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    # one kind of join at every size: what is shuffled grows with the input, not by leaps where a side gets too large to be sent whole
    candidates = hashed.join(repeated.hint("merge"), "h").groupBy("id", "th").agg(F.collect_set("a").alias("starts"))
    candidates = cut(candidates.select(F.col("id").alias("cid"), F.col("th").alias("cth"), "starts"), "candidates")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in docs_in(batches, 2, 2 << 20, binary=True):
            row, found = [], []
            for i, (text, starts) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                own = run(text, set(starts))
                found += own
                row += [i] * len(own)
            row, columns = pa.array(row, pa.int64()), list(zip(*found, strict=True)) or [()] * 5
            columns = [pa.array(c, pa.int32()) for c in columns[:2]] + [pa.array(c, pa.binary()) for c in columns[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *columns], names=["id", "th", "a", "b", "data", "before", "after"])

    wanted = may_hold(slim, "th", candidates, "cth", "held").where("held")  # most texts need no shuffle
    near = wanted.join(candidates.hint("merge"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")))
    read = cut(near.select("id", "th", "t", "starts").mapInArrow(spans, f"id {kind}, th bigint, a int, b int, data binary, before binary, after binary"), "spans")
    place = F.struct("id", "th", "a")
    first = read.groupBy("data").agg(F.min(F.struct("id", "th", "a", "before", "after")).alias("first"), F.max(place).alias("last"))
    first = cut(first.select("data", F.expr("struct(first.id, first.th, first.a)").alias("place"), "first.before", "first.after", "last").where("place <> last").select("data", "place", F.col("before").alias("fbefore"), F.col("after").alias("fafter")), "first")
    more = read.join(first.hint("merge"), "data").where(~place.eqNullSafe(F.col("place")))

    def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, other_before, other_after = (batch.column(i).to_pylist() for i in range(4, 8))
            back = np.array([grown(x, y, -1) for x, y in zip(before, other_before, strict=True)], np.int32)
            on = np.array([grown(x, y, 1) for x, y in zip(after, other_after, strict=True)], np.int32)
            a, b = batch.column(2).to_numpy() - back, batch.column(3).to_numpy() + on
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "th", "a", "b"])

    if grow:
        more = more.select("id", "th", "a", "b", "before", "after", "fbefore", "fafter").mapInArrow(larger, f"id {kind}, th bigint, a int, b int")
    runs = cut(more.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "runs")
    drop_cuts(repeated, candidates, read, first)
    return runs


def _chunk_runs(slim: DataFrame, hashes: DataFrame, rules: ChunkRules, grow: bool) -> DataFrame:
    def read(text: bytes, starts: set[int]) -> list[tuple]:
        lines, out = text.split(b"\n"), []
        for a, b, low, high in compared_chunks(text, rules, grow):
            if a in starts:
                near = (b"\n".join(lines[low:a]) if grow and low < a else None, b"\n".join(lines[b:high]) if grow and b < high else None)
                out.append((a, b, b"\n".join(lines[a:b]), *near))
        return out

    hashed = hashes.select("id", "th", F.explode(F.arrays_zip(F.col("starts").alias("a"), F.col("hashes").alias("h"))).alias("x")).select("id", "th", "x.a", "x.h")
    return _repeated_runs(slim, hashed, read, grow)


def _pair_runs(slim: DataFrame, hashes: DataFrame, runs: DataFrame) -> DataFrame:
    """_repeated_runs of neighbouring lines with words that no one run holds."""
    kind = slim.schema["id"].dataType.simpleString()

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, hashed = [], [], []
            for i, (worded, pairs, held) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                if not pairs:
                    continue
                worded, pairs = np.array(worded), np.array(pairs, np.int64)
                free = np.ones(len(pairs), bool)
                if held:
                    begin, end = np.array(sorted((r["a"], r["b"]) for r in held)).T
                    at = np.searchsorted(begin, worded[:-1], "right")  # runs that begin at the pair or before it
                    reach = np.concatenate(([-1], np.maximum.accumulate(end)))
                    free = reach[at] <= worded[1:]
                row += [i] * int(free.sum())
                starts.append(worded[:-1][free])
                hashed.append(pairs[free])
            row = pa.array(row, pa.int64())
            columns = [pa.array(np.concatenate(x) if x else np.array([]), k) for x, k in ((starts, pa.int32()), (hashed, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *columns], names=["id", "th", "a", "h"])

    def read(text: bytes, starts: set[int]) -> list[tuple]:
        lines = text.split(b"\n")
        full = [i for i, worded in enumerate(_worded(lines)) if worded]
        return [(i, j + 1, b"\n".join(lines[i : j + 1]), None, None) for i, j in zip(full, full[1:], strict=False) if i in starts]

    found = runs.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "runs")
    joined = hashes.join(found.hint("merge"), hashes["id"].eqNullSafe(found["rid"]) & (hashes["th"] == found["rth"]), "left")
    pairs = cut(joined.select("id", "th", "worded", "pairs", "runs").mapInArrow(left, f"id {kind}, th bigint, a int, h bigint"), "pairs")
    out = _repeated_runs(slim, pairs, read, False)
    drop_cuts(pairs)
    return out


def _without(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str, removed_col: str | None) -> DataFrame:
    """docs without the lines of their runs."""
    gone_id, gone_hash, gone_runs = "gid", "gth", "gone"
    gone = runs.groupBy("id", "th").agg(F.flatten(F.collect_list("runs")).alias(gone_runs)).select(F.col("id").alias(gone_id), F.col("th").alias(gone_hash), gone_runs)
    at, n_columns = docs.columns.index(text_col), len(docs.columns)
    kept = [T.StructField(f.name, T.StringType(), f.nullable) if i == at else f for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*kept, *([T.StructField(removed_col, T.LongType())] if removed_col else [])])
    names = schema.names

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in docs_in(batches, at, 2 << 20, binary=True):
            new, removed = [], []
            for text, gone in zip(texts, batch.column(n_columns).to_pylist(), strict=True):
                drop: set[int] = set()
                if gone:
                    for r in gone:
                        drop.update(range(r["a"], r["b"]))
                    text = b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in drop)
                new.append(text)
                removed.append(len(drop))
            columns = [pa.array(new, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(n_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(removed, pa.int64())] if removed_col else [])], names=names)

    gone = cut(gone, "gone")
    rows = docs.toDF(*(f"c{i}" for i in range(n_columns)))  # whatever the columns' names
    body = F.col(f"c{at}").cast("string")
    rows = may_hold(rows.withColumn("th", F.xxhash64(body)), "th", gone, gone_hash, "held")
    columns = [body.alias(f"c{i}") if i == at else F.col(f"c{i}") for i in range(n_columns)]
    own = F.col(f"c{docs.columns.index(id_col)}").eqNullSafe(F.col(gone_id)) & (F.col("th") == F.col(gone_hash))
    touched = map_batches(rows.where("held").join(gone.hint("merge"), own, "left").select(*columns, gone_runs), clean, schema)
    others = rows.where("not held").select(*columns, *([F.lit(0).cast("bigint")] if removed_col else [])).toDF(*names)
    return touched.union(others)


def passage_runs(docs: DataFrame, rules: ChunkRules = ChunkRules(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, th, runs) of the repeated runs of lines, first those found by chunks, then those found by pairs of the lines that chunks left.

    A chunk that an earlier one equals is grown line by line, forwards and backwards, while the lines are those next to its first place. Its
    neighbouring chunks bound the growth: where one of them is equal as a whole, it is a match of its own. What is left, since it
    holds no whole chunk or was taken over from a later place than the first, is found by each two neighbouring lines with words
    that lie in no one run: of equal pairs the first is in no run, else it would not be the first, so none is missed."""
    slim = _slim(docs, id_col, text_col)
    hashes = cut(_hashes(slim, rules, True), "hashes")
    by_chunks = _chunk_runs(slim, hashes, rules, True)
    by_pairs = _pair_runs(slim, hashes, by_chunks)
    drop_cuts(hashes)
    return by_chunks, by_pairs


def dedup_passages(
    docs: DataFrame, rules: ChunkRules = ChunkRules(), id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None
) -> DataFrame:
    """docs without repeated runs of lines (passage_runs): a line goes if it lies in a run of two or more lines with words, or is a
    line of min_words words, that occurs at an earlier place byte for byte. The first place of every line stays; so do blank lines at a
    run's ends. Places, nulls, repeated rows and columns as in dedup_lines."""
    by_chunks, by_pairs = passage_runs(docs, rules, id_col, text_col)
    return _without(docs, by_chunks.union(by_pairs), id_col, text_col, removed_col)


def dedup_lines(
    docs: DataFrame, rules: ChunkRules = ChunkRules(), id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None
) -> DataFrame:
    """docs with every chunk of lines removed that an earlier one equals byte for byte; removed_col: also the lines removed.

    Earlier: by (id, hash of text, line), null ids first. Only hashes of chunks are grouped over the corpus; the bytes
    of chunks whose hash repeats are then grouped themselves, which is the comparison. A chunk that a third of all documents
    share is a pre-aggregated group and one side of an equality join whose other side is unique and written before, so adaptive
    execution splits it.

    A document left without lines keeps its row with an empty text; null stays null; rows equal in id and text count as one
    document and get the same result; other columns pass unchanged; an empty table gives an empty result.
    """
    slim = _slim(docs, id_col, text_col)
    hashes = cut(_hashes(slim, rules, False), "hashes")
    runs = _chunk_runs(slim, hashes, rules, False)
    drop_cuts(hashes)
    return _without(docs, runs, id_col, text_col, removed_col)
