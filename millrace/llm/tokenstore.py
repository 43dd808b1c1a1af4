"""A content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash over the last ids meets a mask, so equal
passages give equal chunks wherever they stand.  A chunk is named by its digest; every distinct chunk is
stored once in a pack file, in order of first appearance.  The manifest lists documents in ascending
doc_id order with start, length, recipe (the chunks' digests) and the Merkle root over them.

Reading back checks the manifest against its own Merkle root and number of documents, visits every stored chunk once, checks its
bytes against its digest and takes its checksum; documents are then put together from their recipes, their roots are checked, and the
checksum of the whole id stream follows from the chunks' checksums and lengths without moving ids between
machines.  `documents` gives the ids themselves.  A chunk or a document that is missing, or differs, fails the job.

Files: pack = ids of chunks one after another, little-endian, 2 bytes where the vocabulary allows, else 4;
index = Parquet rows (digest, n, pack, offset); manifest = Parquet rows in doc_id order.

Defined cases: null or empty text is the end id alone; documents of any length are stored whole; repeated
rows are documents of their own with the same chunks; a null doc_id comes first; ties of doc_id stand
beside each other in no fixed order; extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import coalesced, dealt_by_bytes, filesystem, lean, new_folder, removed, running_start, scratch, spread, staged
from millrace.llm.tokens import encoder, ids_with_end

WINDOW = 8
LEAST, MEAN, MOST = 64, 512, 4096
#: Digests that a task remembers at a time; a chunk written twice is still stored once in the end.
REMEMBERED = 200_000
ROLL = 256 << 20
#: Bits of a token position in one group of the manifest's tree: a group holds at most 2^16 documents, or groups.
FAN = 16
#: Ids that are put together at a time when documents are read back, unless one document alone is longer.
PIECE = 4 << 20
RECIPE = "array<struct<seq:int,n:int,digest:binary>>"


def cuts(ids: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= least:
        return [n]
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolling = np.zeros(n, np.uint32)
    factor = 1
    for back in range(min(WINDOW, n)):
        rolling[back:] += mixed[: n - back] * np.uint32(factor)
        factor = factor * 0x85EBCA6B % (1 << 32)
    rolling ^= rolling >> np.uint32(16)
    ends, last = [], 0
    for at in (np.flatnonzero(rolling % np.uint32(mean) == 0) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over digests: pairs are hashed level by level, an odd last one moves up as it is."""
    level = leaves or [digest_of(b"")]
    while len(level) > 1:
        level = [digest_of(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_REVERSED = 0xEDB88320  # fixed value: the CRC-32 polynomial, bits reversed


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial; bit 31 stands for x^0."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (_REVERSED if b & 1 else 0)
    return product


@functools.lru_cache(65536)
def _zeros(n_bytes: int) -> int:
    """x^(8 n) modulo the polynomial: what n zero bytes do to a checksum."""
    result, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            result = _times(square, result)
        square = _times(square, square)
        n >>= 1
    return result


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from the CRC-32 of each."""
    return _times(_zeros(second_bytes), first) ^ second


def _staged_chunks(docs: DataFrame, tokenizer: str, end: int, folder: str) -> DataFrame:
    """One row for each chunk of each document; file and offset where this task wrote its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        task = int.from_bytes(os.urandom(5), "little") >> 1
        row, out, name, at = 0, None, "", 0
        known: set[bytes] = set()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64()]
        names = ["doc_id", "row", "seq", "n", "digest", "file", "offset"]
        try:
            for batch in batches:
                keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for start in range(0, len(texts), 500):
                    rows = []
                    for key, ids in zip(keys[start : start + 500], ids_with_end(tokenizer, texts[start : start + 500], end), strict=True):
                        row += 1
                        if row >> 24:  # the task's number is used up
                            task, row = int.from_bytes(os.urandom(5), "little") >> 1, 0
                        last = 0
                        for seq, stop in enumerate(cuts(ids)):
                            data = ids[last:stop].tobytes()
                            digest = digest_of(data)
                            file, offset = None, None
                            if digest not in known:
                                if out is None or at >= ROLL:
                                    if out is not None:
                                        out.close()
                                    fs.create_dir(path, recursive=True)
                                    name, at = f"{uuid.uuid4().hex}.ids", 0
                                    out = fs.open_output_stream(f"{path}/{name}")
                                if len(known) >= REMEMBERED:
                                    known.clear()
                                known.add(digest)
                                out.write(data)
                                file, offset = f"{folder}/{name}", at
                                at += len(data)
                            rows.append((key, task << 24 | row, seq, stop - last, digest, file, offset))
                            last = stop
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    schema = "doc_id long, row long, seq int, n int, digest binary, file string, offset long"
    return staged(spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lean(run), schema), "chunks")


def _ranges_read(rows: pa.RecordBatch, width: int, file_column: str) -> Iterator[tuple[list[int], list[bytes]]]:
    """Coalesced reads of the chunks of a batch: row numbers and their bytes."""
    files, offsets, sizes = rows.column(file_column).to_pylist(), rows.column("offset").to_pylist(), rows.column("n").to_pylist()
    ranges = [(f, o, n * width) for f, o, n in zip(files, offsets, sizes, strict=True)]
    open_name, handle = None, None
    for file, start, end, inside in coalesced(ranges):
        if file != open_name:
            if handle is not None:
                handle.close()
            fs, path = filesystem(file)
            open_name, handle = file, fs.open_input_file(path)
        handle.seek(start)
        data = handle.read(end - start)
        yield inside, [data[ranges[i][1] - start : ranges[i][1] - start + ranges[i][2]] for i in inside]
    if handle is not None:
        handle.close()


def _packed(unique: DataFrame, folder: str, width: int) -> DataFrame:
    """Copies each distinct chunk once into the store's packs; the index of the store."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                digests, sizes = batch.column("digest").to_pylist(), batch.column("n").to_pylist()
                rows = []
                for inside, chunks in _ranges_read(batch, width, "file"):
                    for i, data in zip(inside, chunks, strict=True):
                        if out is None or at >= ROLL:
                            if out is not None:
                                out.close()
                            fs.create_dir(path, recursive=True)
                            name, at = f"{uuid.uuid4().hex}.pack", 0
                            out = fs.open_output_stream(f"{path}/{name}")
                        out.write(data)
                        rows.append((digests[i], sizes[i], f"{folder}/{name}", at))
                        at += len(data)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int32(), pa.string(), pa.int64()], strict=True)], names=["digest", "n", "pack", "offset"])
        finally:
            if out is not None:
                out.close()

    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = unique.select("digest", "n", "file", "offset").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return staged(ordered.mapInArrow(lean(run), "digest binary, n int, pack string, offset long"), "store-index", keep=True)


@dataclass(frozen=True)
class Store:
    """Where a store lies: packs (named in the index), its index, its manifest with root and number of documents, and the bytes of an id."""

    index: DataFrame
    manifest: DataFrame
    width: int
    root: bytes
    documents: int


def write(docs: DataFrame, tokenizer: str, end: int = 1) -> Store:
    spark: SparkSession = docs.sparkSession
    width = encoder(tokenizer).type.itemsize
    waiting = new_folder(spark, "unsorted-ids")
    with scratch():
        chunks = _staged_chunks(docs, tokenizer, end, waiting)
        once = chunks.where("file IS NOT NULL").groupBy("digest").agg(F.min(F.struct("file", "offset", "n")).alias("c"))
        index = _packed(staged(once.select("digest", "c.file", "c.offset", "c.n"), "unique"), new_folder(spark, "store"), width)
        removed(waiting)  # its chunks are in the store now
        recipes = chunks.groupBy("doc_id", "row").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "digest"))).alias("recipe"))
        # Rows come out of running_start dealt by range and in order within their range.
        started = running_start(recipes, [F.col("doc_id").asc_nulls_first(), F.col("row")], "n_tokens", "start")
        manifest = staged(_with_roots(started), "manifest", keep=True)
    return Store(index, manifest, width, *manifest_root(manifest))


def _with_roots(recipes: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root([c["digest"] for c in r]) for r in batch.column("recipe").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])

    rows = recipes.select("doc_id", "row", "start", "n_tokens", "recipe")
    return rows.mapInArrow(lean(run), f"doc_id long, row long, start long, n_tokens long, recipe {RECIPE}, root binary")


def manifest_root(manifest: DataFrame) -> tuple[bytes, int]:
    """Root over the documents' roots in manifest order, and their number; the same however rows are dealt.

    Documents whose starts agree but for the last FAN bits make a group, whose Merkle root goes up a level
    under the remaining bits; a group has at most 2^FAN members, as every document holds a token.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root([b"".join((m["start"].to_bytes(8, "big", signed=True), m["root"])) for m in g]) for g in batch.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("n"), pa.array(roots, pa.binary())], names=["start", "n", "root"])

    level = manifest.select("start", F.lit(1).cast("long").alias("n"), "root")
    for _ in range(64 // FAN):
        groups = level.groupBy(F.shiftright("start", FAN).alias("up")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("start", "root"))).alias("members"))
        level = groups.select(F.col("up").alias("start"), "n", "members").mapInArrow(lean(run), "start long, n long, root binary")
    top = level.collect()
    return (bytes(top[0]["root"]), top[0]["n"]) if top else (merkle_root([]), 0)


def _verified(store: Store) -> DataFrame:
    """Every stored chunk, read once: digest, ids in it, CRC-32 of its ids as 32-bit integers."""
    width = store.width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            rows = []
            for inside, chunks in _ranges_read(batch, width, "pack"):
                for i, data in zip(inside, chunks, strict=True):
                    _same_digest(data, digests[i])
                    rows.append((digests[i], len(data) // width, zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4"))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int32(), pa.int64()], strict=True)], names=["digest", "n", "crc"])

    dealt = dealt_by_bytes(store.index.select("digest", "n", "pack", "offset"), "pack", "offset", F.col("n") * width)
    return dealt.mapInArrow(lean(run), "digest binary, n int, crc long")


def _same_digest(data: bytes, digest: bytes) -> None:
    if digest_of(data) != digest:
        raise ValueError(f"damaged chunk {digest.hex()}")


def _checked_manifest(store: Store) -> DataFrame:
    if manifest_root(store.manifest) != (store.root, store.documents):
        raise ValueError("the manifest differs from its root: documents are missing, added or changed")
    return store.manifest


def _check_recipe(root: bytes, chunks: list[dict], found: str) -> None:
    for c in chunks:
        if c[found] is None:
            raise ValueError(f"missing chunk {c['digest'].hex()}")
    if merkle_root([c["digest"] for c in chunks]) != root:
        raise ValueError("a document's chunks do not match its root")


def _with_chunks(manifest: DataFrame, chunks: DataFrame, *found: str) -> DataFrame:
    """doc_id, start, n_tokens, root and the chunks of each document in order, with the columns found for them or nulls."""
    document = ["doc_id", "row", "start", "n_tokens", "root"]
    parts = manifest.select(*document, F.explode("recipe").alias("c")).select(*document, "c.seq", "c.digest")
    joined = parts.join(chunks, "digest", "left")
    return joined.groupBy(*document).agg(F.array_sort(F.collect_list(F.struct("seq", *found, "digest"))).alias("chunks")).drop("row")


def read(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the manifest and the packs."""
    joined = _with_chunks(_checked_manifest(store), _verified(store), "n", "crc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for root, n_tokens, chunks in zip(*(batch.column(c).to_pylist() for c in ("root", "n_tokens", "chunks")), strict=True):
                _check_recipe(root, chunks, "crc")
                crc, size = 0, 0
                for c in chunks:
                    crc = crc_joined(crc, c["crc"], 4 * c["n"])
                    size += c["n"]
                if size != n_tokens:
                    raise ValueError("a document's chunks hold another number of ids than its manifest says")
                sizes.append(size)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(store: Store, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, ids of every document, or of those whose doc_id is in `wanted`: read from the packs by ranges, checked by digest and root."""
    manifest = _checked_manifest(store)
    if wanted is not None:
        manifest = manifest.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    joined = _with_chunks(manifest, store.index.select("digest", "n", "pack", "offset"), "n", "pack", "offset")
    width = store.width

    def put_together(rows: list[tuple]) -> pa.RecordBatch:
        every = pa.RecordBatch.from_pylist([c for *_, chunks in rows for c in chunks])
        held: list[bytes] = [b""] * every.num_rows
        for inside, pieces in _ranges_read(every, width, "pack"):
            for i, data in zip(inside, pieces, strict=True):
                _same_digest(data, every.column("digest")[i].as_py())
                held[i] = data
        sizes = [len(chunks) for *_, chunks in rows]
        ends = np.cumsum(sizes).tolist()
        ids = [np.frombuffer(b"".join(held[e - n : e]), f"<u{width}").astype(np.int32) for e, n in zip(ends, sizes, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, start, n_tokens, root, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root", "chunks")), strict=True):
                _check_recipe(root, chunks, "pack")
                if rows and size + n_tokens > PIECE:
                    yield put_together(rows)
                    rows, size = [], 0
                rows.append((doc_id, start, chunks))
                size += n_tokens
            if rows:
                yield put_together(rows)

    return joined.mapInArrow(lean(run), "doc_id long, start long, ids array<int>")
