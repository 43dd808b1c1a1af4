"""Shared ground of the training-data operators: the word rule, the shared folder, staged tables, running sums."""

from __future__ import annotations

import contextvars
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir where it is set.

    Unset on a local master, where driver and executors are one process (tests): a folder of this machine.
    Unset on a cluster: beside the warehouse, which is shared by definition; a machine-local folder is never used there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        root = _local_folder() if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_millrace"
    return root if re.match(r"^[A-Za-z][\w+.-]*:", root) else f"file://{root}"


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of the shared root that nobody else uses."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the folders of the tables that `staged` writes inside, but for those it is told to keep."""
    scope: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), scope))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in scope:
            removed(path)


def removed(path: str) -> None:
    """Removes a folder of the shared root, if it is there."""
    fs, place = filesystem(path)
    if fs.get_file_info(place).type.name == "Directory":
        fs.delete_dir(place)


#: Spark's setting that removes the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors, frees df's shuffles.

    Inside `scratch` the table goes when that block ends; kept tables last one block longer, and those
    of no block until the shared folder is emptied, as a lazy result may still read them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI, for use inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^file:/*", "file:///", uri))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew only when a scan came in fewer splits than there are cores; anything above an exchange is dealt already."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


#: Rows up to which a written table goes to every task whole.
BROADCAST_ROWS = 50_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows; larger ones are joined by a shuffle that adapts to skew."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lean(work: Callable) -> Callable:
    """Work of a task on Arrow data that gives its memory back when it ends: workers live on, and each would keep the peak of all it ever ran."""

    @functools.wraps(work)
    def run(batches):  # noqa: ANN001, ANN202
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def running_start(df: DataFrame, order: list[Column], amount: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over all rows before this one in the given order, without one task for all.

    Rows are dealt by range and staged with their partition's number; per-partition sums (one row a
    partition, so bounded by the number of partitions) are turned into offsets by a small window, and each
    partition then sums its own rows.  Rows of equal order key stand beside each other in one partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = staged(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = part.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        part.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_part", "_inside", "_offset")
    )


#: Byte ranges closer than GAP are read at once, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20


def coalesced(ranges: list[tuple[str, int, int]], gap: int = GAP) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted ranges (file, offset, length) as few reads: file, start, end and the numbers of the ranges inside."""
    file, start, end, inside = "", 0, 0, []
    for i in sorted(range(len(ranges)), key=lambda i: ranges[i][:2]):
        f, o, n = ranges[i]
        if inside and f == file and o - end <= gap and o + n - start <= READ:
            end = max(end, o + n)
            inside.append(i)
            continue
        if inside:
            yield file, start, end, inside
        file, start, end, inside = f, o, o + n, [i]
    if inside:
        yield file, start, end, inside


#: Bytes of one file that are read by one task in a row, and bytes that a task is given in all.
SPAN, TASK = 8 << 20, 32 << 20


def dealt_by_bytes(rows: DataFrame, file: str, offset: str, size: Column) -> DataFrame:
    """Deals rows that name byte ranges so that tasks read about TASK bytes each, spans of a file in order.

    A split of such rows stands for bytes many times its own size, so reading tasks follow the bytes.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK))
    span = F.floor(F.col(offset) / max(1, min(SPAN, total // parts)))
    return rows.repartition(parts, file, span).sortWithinPartitions(file, offset)
