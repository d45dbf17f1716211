"""Token ids as length-delimited binary records in shards, each with an index of offsets for shuffled reads."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import id_encoder, rank_encoding
from .shared import docs_in, make_path, quoted

#: What a shard's first record says, beside the width of its ids.
FORMAT = {"format": "token-records", "version": 1}
_OWN = struct.Struct("<Bq")  # a record's payload begins with: 1 if the id is given, the id
_ENTRY = np.dtype([("offset", "<u8"), ("tokens", "<u8")])


def masked(data: bytes) -> int:
    """CRC-32 of data, rotated by 15 bits and moved by a constant, so that a checksum of bytes that hold checksums is no fixed point."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """length (8 bytes), masked checksum of these bytes (4), payload, masked checksum of the payload (4); all little-endian."""
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def _framed(key: int | None, ids: bytes) -> bytes:
    return frame(_OWN.pack(key is not None, key or 0) + ids)


def unframe(data, at: int = 0) -> tuple[int, memoryview]:
    """(end, payload) of the record at `at`; ValueError if it is cut off or a checksum differs."""
    view = memoryview(data)
    head, body = bytes(view[at : at + 8]), at + 12
    if len(view) < body or masked(head) != int.from_bytes(view[at + 8 : body], "little"):
        raise ValueError(f"record at {at}: its length is damaged")
    end = body + int.from_bytes(head, "little")
    if len(view) < end + 4:
        raise ValueError(f"record at {at}: cut off")
    payload = view[body:end]
    if masked(payload) != int.from_bytes(view[end : end + 4], "little"):
        raise ValueError(f"record at {at}: its payload is damaged")
    return end + 4, payload


def write_records(
    docs: DataFrame, vocabulary: str, root: str, end_id: int | None = None, roll_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of each row's text, and end_id if given, under `root`, a new folder at a URI that all nodes share.

    (shard, records, tokens, bytes) of each shard; nothing is written before an action takes these rows. Ids are those that the tokenizers
    library gives for the byte-level BPE .json file (id_encoder), in the least of 2 or 4 bytes that holds the vocabulary.

    A shard `shard-<partition>-<number>.rec` is a header record and one record a row; beside it, `.idx` is one record with the
    offset and number of ids of each. Rows are dealt by ranges of (id, hash of the text) and sorted within them, so names in
    order and rows in each shard ascend by id (null ids first, equal ids by hash). Rows that are equal in both are spread by
    a seeded number, so no id can fill a task. Shards are rolled by size; a file is written under its attempt's own name and then renamed to
    one fixed by partition, so a task that runs again replaces its files by equal ones.

    A null text has no ids but end_id; a null id stays null; repeated rows are repeated records; other columns are not read; an
    empty table writes no file, only the folder. A text is held whole with its ids, however long; ids must be integers.
    """
    make_path(docs.sparkSession, root)  # also where there are no rows
    key, text = F.col(quoted(id_col)).cast("bigint").alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("t")
    rows = docs.select(key, text).select("id", F.xxhash64("t").alias("h"), F.rand(11).alias("r"), "t")
    placed = rows.repartitionByRange("id", "h", "r").sortWithinPartitions("id", "h", "r").select("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoding, special = rank_encoding(vocabulary)
        dtype = "<u2" if max(encoding.n_vocab, (special or 0) + 1, (end_id or 0) + 1) <= 1 << 16 else "<u4"
        encode, width = id_encoder(vocabulary, dtype), np.dtype(dtype).itemsize
        last = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        store, base = fs.FileSystem.from_uri(root)
        context = TaskContext.get()
        part = f"{context.partitionId():06d}"
        attempt = f"{base}/_{part}-{context.taskAttemptId()}"
        done, sink, entries, at = [], None, [], 0

        def close() -> None:
            sink.close()
            index = np.array(entries, _ENTRY)
            name = f"shard-{part}-{len(done):05d}"
            with store.open_output_stream(f"{attempt}.idx", compression=None) as out:
                out.write(frame(index.tobytes()))
            store.move(f"{attempt}.idx", f"{base}/{name}.idx")
            store.move(f"{attempt}.rec", f"{base}/{name}.rec")
            done.append((name, len(index), int(index["tokens"].sum()), at))

        for batch, texts in docs_in(batches, 1, 1 << 20):
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if sink is None:
                    sink = store.open_output_stream(f"{attempt}.rec", compression=None)
                    head = frame(json.dumps(FORMAT | {"bytes_per_id": width}).encode())
                    sink.write(head)
                    entries, at = [], len(head)
                ids = (encode(text) if text else b"") + last
                data = _framed(key, ids)
                sink.write(data)
                entries.append((at, len(ids) // width))
                at += len(data)
                if at >= roll_bytes:
                    close()
                    sink = None
            batch = texts = text = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            dict(zip(("shard", "records", "tokens", "bytes"), zip(*done, strict=True), strict=True)) if done else {"shard": [], "records": [], "tokens": [], "bytes": []},
            pa.schema([("shard", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]),
        )

    return placed.mapInArrow(run, "shard string, records bigint, tokens bigint, bytes bigint")


def _width(payload: memoryview) -> int:
    head = json.loads(bytes(payload))
    if {k: head.get(k) for k in FORMAT} != FORMAT or head.get("bytes_per_id") not in (2, 4):
        raise ValueError(f"not a shard of token records: {head}")
    return head["bytes_per_id"]


def _record(payload: memoryview, width: int) -> tuple[int | None, bytes]:
    """(id, ids as little-endian unsigned 32-bit) of a record."""
    given, key = _OWN.unpack_from(payload)
    return key if given else None, np.frombuffer(payload[_OWN.size :], f"<u{width}").astype("<u4").tobytes()


def _files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"shard-*.{kind}").load(root)
    return files.select(F.regexp_extract("path", rf"([^/]*)\.{kind}$", 1).alias("shard"), "content")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """(shard, place, offset, tokens, start) of each record, from the index files alone; start: ids before it in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index = np.frombuffer(unframe(batch.column(1)[i].as_buffer())[1], _ENTRY)
                for begin in range(0, len(index), 1 << 16):
                    part = index[begin : begin + (1 << 16)]
                    before = int(index["tokens"][:begin].sum())
                    columns = [np.arange(begin, begin + len(part)), part["offset"], part["tokens"], before + np.cumsum(part["tokens"]) - part["tokens"]]
                    name = pa.array([batch.column(0)[i].as_py()] * len(part), pa.string())
                    yield pa.RecordBatch.from_arrays([name, *(pa.array(c.astype(np.int64)) for c in columns)], names=["shard", "place", "offset", "tokens", "start"])

    return _files(spark, root, "idx").mapInArrow(run, "shard string, place bigint, offset bigint, tokens bigint, start bigint")


def read_records(spark: SparkSession, root: str, with_ids: bool = True) -> DataFrame:
    """(shard, place, offset, id, start, n_tokens, ids_crc32, ids) of every record, each checked; start: ids before it in its shard.

    ids are little-endian unsigned 32-bit integers whatever their width in the file, null unless with_ids; ids_crc32 is their CRC-32.
    A damaged record fails the read, naming shard and offset. Files are read by Spark, one at a time in a task.
    """
    names = ["shard", "place", "offset", "id", "start", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                try:
                    at, head = unframe(data)
                    width, rows, held, place, start = _width(head), [], 0, 0, 0
                    while at < len(data):
                        here, (at, payload) = at, unframe(data, at)
                        key, ids = _record(payload, width)
                        rows.append((shard, place, here, key, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        held, place, start = held + len(ids) * with_ids, place + 1, start + len(ids) // 4
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{shard}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                data = payload = None

    return _files(spark, root, "rec").mapInArrow(
        run, "shard string, place bigint, offset bigint, id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    )


def shuffled_records(spark: SparkSession, root: str, seed: int = 0) -> DataFrame:
    """(turn, id, n_tokens, ids) of every record in an order drawn from seed: only index entries are shuffled, and each record is
    then read by its offset. turn ascends within a partition and from one to the next; the same seed gives the same order."""
    order = F.xxhash64(F.lit(seed), "shard", "place")
    entries = read_index(spark, root).select(order.alias("turn"), "shard", "offset").repartitionByRange("turn").sortWithinPartitions("turn", "shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        open_files: dict = {}
        for batch in batches:
            rows, held = [], 0
            for turn, shard, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard not in open_files:
                    if len(open_files) >= 64:
                        open_files.pop(next(iter(open_files)))[0].close()
                    file = store.open_input_file(f"{base}/{shard}.rec")
                    first = file.read_at(12, 0)
                    open_files[shard] = file, _width(unframe(file.read_at(int.from_bytes(first[:8], "little") + 16, 0))[1])
                file, width = open_files[shard]
                size = int.from_bytes(file.read_at(8, offset), "little")
                key, ids = _record(unframe(file.read_at(size + 16, offset))[1], width)
                rows.append((turn, key, len(ids) // 4, ids))
                held += len(ids)
                if held > 4 << 20 or len(rows) >= 4096:
                    yield _drawn(rows)
                    rows, held = [], 0
            if rows:
                yield _drawn(rows)

    def _drawn(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["turn", "id", "n_tokens", "ids"])

    return entries.mapInArrow(run, "turn bigint, id bigint, n_tokens bigint, ids binary")


def record_starts(spark: SparkSession, root: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, shard, offset) of every record as read from its shard; start: ids of all records before it.

    What the shards before hold comes from the index files: one row a shard is summed in order, whatever the number of records.
    """
    totals = read_index(spark, root).groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    bases = totals.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    found = read_records(spark, root, with_ids=False).join(bases, "shard")
    return found.select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")
