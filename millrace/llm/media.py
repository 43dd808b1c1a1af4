"""Media columns: content-addressed payloads in tar shards.

A payload (UTF-8 text padded with bytes 0 to a positive multiple of 64) is stored without loss as an 8-bit
greyscale PNG, 64 samples a row, in a plain tar file; the member's name is the SHA-256 of the payload, and a
payload met again in a shard is not written again.  Rows carry digest, shard, offset and length.  Metadata
columns (width, height, depth, format) come from range reads of the first bytes of a member only, headers close by in one read; the full
read decodes the samples, checks the digest and computes the feature.

Defined cases: null text is an empty payload of 64 zero bytes; payloads of any length are stored whole;
equal texts give equal values; repeated rows point to one member; a null doc_id is kept; extra columns are
ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import GAP, coalesced, dealt_by_bytes, filesystem, lean, new_folder, spread, staged

ROW = 64
#: Bytes after which a task begins another shard.
ROLL = 256 << 20
#: Digests that a task remembers at a time; beyond, a payload may be stored once more in the same shard.
REMEMBERED = 200_000
#: Bytes of a member that hold the PNG signature and its header chunk.
HEADER = 33
#: Headers closer than this are read at once: about what a request costs, and no more than small members between them.
HEADER_GAP = 4096
#: Members that a task holds computed values of.
MEMO = 4096
LEDGER = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % ROW or (ROW if not payload else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples: bytes) -> bytes:
    """A greyscale PNG of 64 samples a row, unfiltered rows."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, str]:
    """Width, height, depth and format from the first bytes of a member."""
    if first[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG member")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    return width, height, depth, {0: "png/grey", 2: "png/rgb"}.get(colour, "png/other")


def samples(data: bytes) -> np.ndarray:
    """The decoded rows of a PNG written by `png`."""
    at, packed = 8, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += n + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, ROW + 1)[:, 1:]


def feature(rows: np.ndarray) -> str:
    """A 16-cell histogram of the samples in thousandths, and mean and deviation, as text."""
    cells = np.bincount(rows.reshape(-1) >> 4, minlength=16)
    shares = ",".join(map(str, (cells * 1000 // rows.size).tolist()))
    return f"{shares};{rows.mean():.4f};{rows.std():.4f}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block with fixed owner, mode and time, so that equal payloads give equal bytes."""
    block = bytearray(512)
    for at, text in ((0, name[:100]), (100, "0000644\0"), (108, "0000000\0"), (116, "0000000\0"), (124, f"{size:011o}\0"), (136, "00000000000\0"), (148, " " * 8), (156, "0"), (257, "ustar\0"), (263, "00")):
        block[at : at + len(text)] = text.encode()
    block[148:156] = f"{sum(block):06o}\0 ".encode()
    return bytes(block)


def stored(docs: DataFrame) -> DataFrame:
    """Writes the shards into the shared folder and returns the ledger: doc_id, n_bytes, digest, shard, offset, length."""
    folder = new_folder(docs.sparkSession, "media")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        out, name, at = None, "", 0
        known: dict[bytes, tuple[int, int]] = {}
        try:
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                        name, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    raw = (text or "").encode()
                    payload = padded(raw)
                    sha = hashlib.sha256(payload)
                    where = known.get(sha.digest())
                    if where is None:
                        member = png(payload)
                        out.write(tar_header(f"{sha.hexdigest()}.png", len(member)) + member + bytes(-len(member) % 512))
                        where = (at + 512, len(member))
                        at += 512 + len(member) + -len(member) % 512
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[sha.digest()] = where
                    found.append((doc_id, len(raw), sha.hexdigest(), f"{folder}/{name}", *where))
                columns = list(zip(*found, strict=True)) if found else [()] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    return staged(spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lean(run), LEDGER), "media-ledger")


def in_shard_order(ledger: DataFrame) -> DataFrame:
    """The ledger dealt by the bytes behind its rows, each task's rows in shard order."""
    return dealt_by_bytes(ledger, "shard", "offset", F.col("length"))


def _ranges(ledger: DataFrame, fields: list[pa.Field], first: int | None, gap: int, work: Callable[[bytes, str], tuple]) -> DataFrame:
    """Adds columns computed from each row's member, or from its first bytes; neighbouring ranges of a batch are read at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle, memo = None, None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True))
            rows: list[tuple] = [()] * len(keys)
            new: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                if key in memo:
                    rows[i] = memo[key]
                else:
                    new.setdefault(key, []).append(i)
            if len(memo) >= MEMO:
                memo.clear()
            wanted = list(new)
            for shard, start, end, inside in coalesced([(s, o, min(n, first or n)) for s, o, n, _ in wanted], gap):
                if shard != name:
                    if handle is not None:
                        handle.close()
                    fs, path = filesystem(shard)
                    name, handle = shard, fs.open_input_file(path)
                handle.seek(start)
                data = handle.read(end - start)
                for k in inside:
                    _, offset, length, digest = wanted[k]
                    found = work(data[offset - start : offset - start + min(length, first or length)], digest)
                    memo[wanted[k]] = found
                    for i in new[wanted[k]]:
                        rows[i] = found
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], names=[*batch.schema.names, *(f.name for f in fields)])
        if handle is not None:
            handle.close()

    added = [T.StructField(f.name, T.StringType() if f.type == pa.string() else T.LongType()) for f in fields]
    return ledger.mapInArrow(lean(run), T.StructType([*ledger.schema.fields, *added]))


def with_headers(ledger: DataFrame) -> DataFrame:
    """The ledger with width, height, depth and format, from range reads of HEADER bytes a member."""
    fields = [pa.field("width", pa.int64()), pa.field("height", pa.int64()), pa.field("depth", pa.int64()), pa.field("format", pa.string())]
    return _ranges(ledger, fields, HEADER, HEADER_GAP, lambda data, _: header(data))


def _computed(data: bytes, digest: str) -> tuple:
    rows = samples(data)
    payload = rows.tobytes()
    sha = hashlib.sha256(payload).hexdigest()
    if sha != digest:
        raise ValueError(f"member {digest} holds other bytes")
    return len(payload), sha, zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(rows)


def with_features(ledger: DataFrame) -> DataFrame:
    """The ledger with everything computed from the stored bytes read back."""
    text = ("payload_sha256", "media_sha256", "feature")
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return _ranges(ledger, [pa.field(n, pa.string() if n in text else pa.int64()) for n in names], None, GAP, _computed)
