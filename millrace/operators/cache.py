"""Latest-wins tables with expiry: put, get, evict, count over batches."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.native import conditional_headers
from millrace.operators.pages import with_row_functions


def upserted(stored: DataFrame, puts: DataFrame, key: list[str], written: str) -> DataFrame:
    """Both tables with the last written row of each key; a row struct per key is kept as a partial maximum, so hot keys combine before the shuffle."""
    every = stored.unionByName(puts)
    rest = [c for c in every.columns if c not in key]
    order = F.struct(F.col(written), *[F.col(c) for c in rest if c != written])
    return every.groupBy(*key).agg(F.max(order).alias("r")).select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in every.columns])


def alive(stored: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return stored.where(F.col(expires) > now)


def looked_up(requests: DataFrame, stored: DataFrame, key: list[str], now: Column, expires: str = "expires_at") -> DataFrame:
    """Requests with the stored row of their key, if it has not expired, and whether they hit."""
    held = alive(stored, now, expires).withColumn("hit", F.lit(True))
    return requests.join(held, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def evicted(stored: DataFrame, now: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """What stays, and a one-row table with the number of rows removed."""
    return alive(stored, now, expires), stored.where(F.col(expires) <= now).agg(F.count("*").alias("removed"))


def revalidation_headers(stored: DataFrame, etag: str = "etag", last_modified: str = "last_modified") -> DataFrame:
    return stored.withColumn("headers", conditional_headers(F.col(etag), F.col(last_modified)))


def counted(stored: DataFrame) -> DataFrame:
    """The number of stored rows, expired ones among them."""
    return stored.agg(F.count("*").alias("rows"))


def packed_bodies(rows: DataFrame, body: str = "body") -> DataFrame:
    """Bodies as gzip with the SHA-256 of what they were; equal bodies give equal bytes, null stays null."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(body), 256))
    made = with_row_functions(hashed, {"_packed": (body, T.BinaryType(), lambda b: None if b is None else gzip.compress(b, 6, mtime=0))})
    return made.withColumn(body, F.col("_packed")).drop("_packed")


def unpacked_bodies(rows: DataFrame, body: str = "body") -> DataFrame:
    made = with_row_functions(rows, {"_body": (body, T.BinaryType(), lambda b: None if b is None else gzip.decompress(b))})
    return made.withColumn(body, F.col("_body")).drop("_body")
