"""Packing token pieces into sequences of fixed length by first-fit decreasing in randomised groups.

A document's ids are cut at multiples of the sequence length; each piece keeps only its place, length and
checksum, so no ids are shuffled.  Pieces are dealt by a seeded hash of their place in the written table of pieces into
groups of about GROUP pieces, so equal pieces spread like any others, and
each group is packed by itself: pieces by falling length, each into the first bin with room, found through a
tournament tree over the bins' free space in O(log n).

Defined cases: null or empty text is the end id alone; a document of any length is cut, never dropped;
repeated rows are packed each on their own; ties of length go by doc_id, then start; extra columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, spread, staged
from millrace.llm.tokens import ids_with_end

LENGTH = 2048
GROUP = 4096


class FirstFit:
    """Bins of one capacity; a tournament tree holds the largest free space below each node."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.width)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset for a piece: the first bin with room for it."""
        free, node = self.free, 1
        while node < self.width:
            node *= 2
            if free[node] < size:
                node += 1
        offset = self.capacity - free[node]
        bin_ = node - self.width
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the order given; equal sizes keep that order."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    tree = FirstFit(max(1, len(sizes)), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], offsets[i] = tree.place(sizes[i])
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and the task that made it with the piece's number there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"]
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 500):
                rows = []
                for key, ids in zip(keys[at : at + 500], ids_with_end(tokenizer, texts[at : at + 500], end), strict=True):
                    wide = ids.astype("<u4")
                    rows += [(key, s, min(length, len(ids) - s), zlib.crc32(wide[s : s + length]), len(ids), task, number + s // length) for s in range(0, len(ids), length)]
                    number += -(-len(ids) // length)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, seed: int = 2) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = staged(pieces(docs, tokenizer, length), "pieces")
    groups = max(1, round(cut.count() / group))

    def pack(rows: pa.Table) -> pa.Table:
        keys = [("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), length)
        first = rows["g"][0].as_py() << 32
        return rows.drop_columns(["task", "number", "g"]).append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = cut.withColumn("g", F.pmod(F.xxhash64("task", "number", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
