"""Packing by power-of-two decomposition: pieces of binary length, bucketed by length, none across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import id_encoder
from .shared import docs_in


def binary_lengths(n: int, most: int) -> list[int]:
    """n as powers of two of at most `most` (a power of two), longest first."""
    out = [most] * (n // most)
    rest, p = n % most, most >> 1
    while rest:
        if rest >= p:
            out.append(p)
            rest -= p
        p >>= 1
    return out


def pack(
    docs: DataFrame, vocabulary: str, max_len: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, bucket, sequence_id, offset, ids); ids: little-endian unsigned 32-bit, binary.

    A document is its ids by the byte-level BPE .json file, as the tokenizers library gives them (made by tiktoken from the
    file's own ranks, which is five times as fast; the tests hold the two equal; texts with a white-space run of over
    LONG_SPACE characters, on which tiktoken fails, go through the library itself), and then end_id. It is split into its length's binary digits (as many
    pieces of max_len as fit first); each piece is a sequence of its own, so its length is a power of two, nothing is
    padded and nothing crosses documents. bucket is log2 of the length; sequence_id holds bucket, task and place in order,
    so sorting by it puts equal lengths together without a count of all pieces. One narrow pass, no shuffle; the same
    input splits give the same sequence_id, also when a task is run again.

    A null or empty text is one piece of one id; a null id stays null; repeated rows are packed each for itself; other
    columns are not read; an empty table gives no pieces. max_len must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError(f"max_len {max_len} is not a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = id_encoder(vocabulary)
        end, task = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * max_len.bit_length()
        for batch, texts in docs_in(batches, 1, 1 << 20):
            row, start, length, total, bucket, sequence, parts = [], [], [], [], [], [], []
            for i, text in enumerate(texts):
                parts.append((ids_of(text) if text else b"") + end)
                n, at = len(parts[-1]) // 4, 0
                for size in binary_lengths(n, max_len):
                    k = size.bit_length() - 1
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    bucket.append(k)
                    sequence.append(k << 58 | task << 33 | seen[k])
                    seen[k] += 1
                    at += size
            # pieces follow each other without a gap, so their ids are one buffer with the pieces' ends as offsets
            ends = np.zeros(len(length) + 1, np.int32)
            np.cumsum(np.array(length, np.int32) * 4, out=ends[1:])
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(bucket, pa.int32()),
                    pa.array(sequence, pa.int64()),
                    ids,
                ],
                names=["id", "start", "length", "doc_tokens", "bucket", "sequence_id", "ids"],
            )
            batch = texts = text = parts = ids = None  # let go before the next batch is read

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"id {kind}, start bigint, length bigint, doc_tokens bigint, bucket int, sequence_id bigint, ids binary"
    )
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "doc_tokens", "bucket", "sequence_id", F.lit(0).cast("bigint").alias("offset"), "ids"
    )
