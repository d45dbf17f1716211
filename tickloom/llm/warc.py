"""WARC archives: a writer with revisit records and a salvage reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
_MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record: version line, headers, block and the two line ends; the block's digest and length are added."""
    own = headers | {"WARC-Block-Digest": "sha1:" + sha1_base32(block), "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in own.items())
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def framed_end(data: bytes, at: int) -> int | None:
    """Where the record at `at` ends by its own length, if what follows confirms it: its two line ends, then a version line, a member or
    nothing more. Such a record is whole in itself, even if its digest fails, so no record is looked for inside it."""
    begin = data.find(b"\r\n\r\n", at)
    if begin < 0 or not _VERSION_LINE.match(data, at) or not (length := _LENGTH.search(data, at, begin + 2)):
        return None
    end = begin + 4 + int(length[1])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    end += 4
    return end if end == len(data) or data.startswith(_MEMBER, end) or _VERSION_LINE.match(data, end) else None


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """(end, headers in lower case, block) of the record at `at`; ValueError with the failed check."""
    if not _VERSION_LINE.match(data, at):
        raise ValueError("no version line")
    begin = data.find(b"\r\n\r\n", at)
    if begin < 0:
        raise ValueError("headers do not end")
    lines = data[at:begin].split(b"\r\n")[1:]
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = begin + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end with the record")
    block = data[begin + 4 : end]
    digest = headers.get("warc-block-digest")
    if digest and digest.lower().startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise ValueError("block digest differs")
    return end + 4, headers, block


def parse_member(data: bytes, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]]:
    """(end, records) of the gzip member at `at`; ValueError if its checks or its records' fail."""
    inflate = zlib.decompressobj(31)
    parts, end = [], at
    try:
        while not inflate.eof:
            if end >= len(data):
                raise ValueError("member is cut off")
            fed = data[end : end + (1 << 16)]
            parts.append(inflate.decompress(fed))
            end += len(fed)
    except zlib.error as e:
        raise ValueError(f"member: {e}") from e
    end -= len(inflate.unused_data)
    plain, found, here = b"".join(parts), [], 0
    while here < len(plain):
        here, headers, block = parse_record(plain, here)
        found.append((headers, block))
    if not found:
        raise ValueError("member without record")
    return end, found


def _plain_of(data: bytes, at: int) -> bytes:
    """What the member at `at` inflates to up to its first fault, in small steps so that little before the fault is lost."""
    inflate, parts = zlib.decompressobj(31), []
    try:
        for begin in range(at, len(data), 256):
            parts.append(inflate.decompress(data[begin : begin + 256]))
            if inflate.eof:
                break
    except zlib.error:
        pass
    return b"".join(parts)


def _records_in(plain: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a failed member's bytes that pass their own checks, found by their version lines."""
    found, here = [], 0
    while line := _VERSION_LINE.search(plain, here):
        try:
            here, headers, block = parse_record(plain, line.start())
            found.append((headers, block))
        except ValueError:
            here = framed_end(plain, line.start()) or line.start() + 1
    return found


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", begin, end, (headers, block)) or ("gap", begin, end, failed check), in order and without holes.

    At each place a gzip member or a plain record is read and checked. If that fails, the next member or version line whose
    record passes all checks is searched for; the bytes up to it are one gap. A record that only fails in itself (its digest differs,
    but it ends where its length says and another follows) is one gap: what its payload quotes is no record. A member that fails (a fault in its stream, its
    end missing, one bad record among many) is a gap as a whole, but those of its records that pass their own checks are
    given too, before the gap and with an empty span.
    """
    at, size = 0, len(data)

    def read(here: int) -> tuple[int, list]:
        if data.startswith(_MEMBER, here):
            return parse_member(data, here)
        end, headers, block = parse_record(data, here)
        return end, [(headers, block)]

    while at < size:
        try:
            end, found = read(at)
        except ValueError as e:
            if whole := framed_end(data, at):
                yield "gap", at, whole, str(e)
                at = whole
                continue
            why, here, end = str(e), at + 1, size
            if data.startswith(_MEMBER, at):
                for one in _records_in(_plain_of(data, at)):
                    yield "record", at, at, one
            while True:
                member, line = data.find(_MEMBER, here), _VERSION_LINE.search(data, here)
                spots = [x for x in (member, line.start() if line else -1) if x >= 0]
                if not spots:
                    yield "gap", at, size, why
                    return
                here = min(spots)
                try:
                    end, found = read(here)
                    break
                except ValueError:
                    if data.startswith(_MEMBER, here) and _records_in(_plain_of(data, here)):
                        end, found = here, []  # a failed member with records of its own: a gap by itself
                        break
                    if framed_end(data, here):
                        end, found = here, []  # so is a failed record that is whole
                        break
                    here += 1
            yield "gap", at, here, why
            at = here
        for headers, block in found:
            yield "record", at, end, (headers, block)
        at = end


def write_archives(
    pages: DataFrame,
    root: str,
    min_payload: int = 0,
    roll_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record per row of pages into gzip WARC files under `root`, a URI all nodes share; (file, records, bytes) of each.

    Of rows with equal payloads of at least min_payload bytes, the one with the smallest id is a response, the others revisit
    it. Only digests are grouped; payloads move only if Spark joins the repeated digests by a shuffle. Files are rolled by size,
    written under a task's own name and then renamed to one fixed by partition, so a task that runs again replaces its files.

    A null payload is empty; a null url is an empty one; a row with a null id is always a response; rows of one id and payload
    are all responses; other columns are not read; an empty table writes no file.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.length("payload") >= min_payload).groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    repeated = repeated.where("least < most").select(F.col("digest").alias("d"), "least")
    records = rows.join(repeated, rows["digest"] == repeated["d"], "left").select(
        "id", "url", "payload", F.when(F.col("id") > F.col("least"), F.col("least")).alias("refers")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}"
        attempt = f"{base}/_{name}-{context.taskAttemptId()}"
        done, sink, held, written = [], None, 0, 0

        def close() -> None:
            nonlocal sink
            sink.close()
            final = f"{base}/{name}-{len(done):05d}.warc.gz"
            store.move(attempt, final)
            done.append((final, held, written))
            sink = None

        for batch in batches:
            for key, url, data, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    sink, held, written = store.open_output_stream(attempt, compression=None), 0, 0
                own = f"{context.partitionId()}.{len(done)}.{held}" if key is None else key
                url = re.sub(r"[\r\n]", " ", url)
                headers = {
                    "WARC-Type": "response" if refers is None else "revisit",
                    "WARC-Record-ID": f"<urn:page:{own}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": url,
                    "WARC-Payload-Digest": "sha1:" + sha1_base32(data),
                }
                if key is not None:
                    headers["X-Page-ID"] = str(key)
                if refers is None:
                    block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(data) + data
                else:
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    headers["WARC-Refers-To"] = f"<urn:page:{refers}>"
                    block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(data)
                headers["Content-Type"] = "application/http;msgtype=response"
                deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = deflate.compress(record_bytes(headers, block)) + deflate.flush()
                sink.write(member)
                held += 1
                written += len(member)
                if written >= roll_bytes:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            {"file": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]},
            pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    return records.mapInArrow(run, "file string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """(file, kind, begin, end, record_type, record_id, target_uri, page_id, refers_to, payload_bytes, payload_digest, reason, payload).

    kind is `record` or `gap`: a gap's bytes failed the check that `reason` names and are quarantined by their place only.
    payload_bytes and payload_digest of a response are taken from its payload as read, those of a revisit, which holds no payload,
    from its own headers: the digest from the record's, the size from the content length of the HTTP response revisited. Files are read by Spark, so any store will do; one file is held at a time.
    """
    schema = pa.schema(
        [("file", pa.string()), ("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("record_type", pa.string())]
        + [("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("reason", pa.string()), ("payload", pa.binary())]
    )

    def row(file: str, kind: str, begin: int, end: int, what: object) -> tuple:
        if kind == "gap":
            return (file, kind, begin, end, *[None] * 7, what, None)
        headers, block = what
        number = lambda x: int(x) if re.fullmatch(r"-?\d+", x) else None
        refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
        size = digest = payload = None
        if headers.get("warc-type") == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), sha1_base32(payload)
        else:
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            length = _LENGTH.search(block.partition(b"\r\n\r\n")[0] + b"\r\n")
            size = int(length[1]) if length else None
        own = (headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), number(headers.get("x-page-id", "")))
        return (file, kind, begin, end, *own, number(refers), size, digest, None, payload if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for found in salvage(data):
                    rows.append(row(file, *found))
                    held += len(rows[-1][-1] or b"")
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(root).select("path", "content")
    return files.mapInArrow(
        run,
        "file string, kind string, begin bigint, end bigint, record_type string, record_id string, target_uri string, page_id bigint, "
        "refers_to bigint, payload_bytes bigint, payload_digest string, reason string, payload binary",
    )
