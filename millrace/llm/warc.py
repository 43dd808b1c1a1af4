"""WARC archives, index first.

Writing gives gzip members, one a record, and an index row for each: page_id, url, digest, record type,
file, offset, length.  Reading starts from the index: selected rows are sorted by file and offset,
neighbouring byte ranges are coalesced into few large reads, and each record is checked against the index.

Among equal payloads the largest page_id is stored as `response`; the others are `revisit` records without
a payload that name it.

Defined cases: null html is an empty payload; null url is an empty target URI; a null page_id counts as the
smallest; rows that repeat the largest page_id of their payload are each a response; payloads are written
and read whole; extra columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import coalesced, dealt_by_bytes, filesystem, lean, new_folder, scratch, sized, spread, staged

#: Bytes after which a task begins another archive file.
ROLL = 512 << 20
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, file string, offset long, length long"
#: Fixed value: the record date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds the response's header block alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def written(pages: DataFrame) -> DataFrame:
    """Writes the archives into the shared folder and returns their index."""
    with scratch():
        return _written(pages)


def _written(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    rows = spread(pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))).withColumn("sha", F.unhex(F.sha1("payload")))
    # Only payloads that repeat need a holder: one narrow row a page is shuffled to find them, and payloads stay where they are read
    # while the holders are few enough for every task; beyond, payloads are joined by digest, where adaptive execution splits a hot one.
    holders = staged(rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("holder")).where("n > 1").withColumn("several", F.lit(True)).drop("n"), "holders")
    alone = F.col("several").isNull()
    marked = rows.join(sized(holders), "sha", "left").select("page_id", "url", "payload", F.when(alone, F.col("page_id")).otherwise(F.col("holder")).alias("holder"), (~alone & ~F.col("page_id").eqNullSafe(F.col("holder"))).alias("revisit"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page_id, url, payload, holder, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    digest = payload_digest(payload)
                    member = record(page_id, url, payload, digest, holder, revisit)
                    out.write(member)
                    found.append((page_id, url, digest, "revisit" if revisit else "response", holder if revisit else None, len(payload), f"{folder}/{name}", at, len(member)))
                    at += len(member)
                yield _index_batch(found)
        finally:
            if out is not None:
                out.close()

    return staged(marked.mapInArrow(lean(run), INDEX), "warc-index", keep=True)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "file", "offset", "length"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads the records that the index rows select: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are computed from its stored payload; a revisit's come from its headers,
    which describe the full payload it stands for.  A record that differs from its index row fails the task.
    """
    ordered = dealt_by_bytes(index.select("page_id", "url", "digest", "file", "offset", "length"), "file", "offset", F.col("length"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, handle = None, None
        for batch in batches:
            page_ids, urls, digests, files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            for file, start, end, inside in coalesced(list(zip(files, offsets, lengths, strict=True))):
                if file != open_name:
                    if handle is not None:
                        handle.close()
                    fs, path = filesystem(file)
                    open_name, handle = file, fs.open_input_file(path)
                handle.seek(start)
                data = handle.read(end - start)
                rows = []
                for i in inside:
                    fields, block = parsed(data[offsets[i] - start : offsets[i] - start + lengths[i]])
                    head, _, body = block.partition(b"\r\n\r\n")
                    claimed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (payload_digest(body) != claimed or len(body) != size) or claimed != digests[i]:
                        raise ValueError(f"damaged record at {file}:{offsets[i]}")
                    other = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((page_ids[i], urls[i], size, claimed, kind, int(other) if other else None, *([body] if with_payload else [])))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if handle is not None:
            handle.close()

    return ordered.mapInArrow(lean(run), schema)
