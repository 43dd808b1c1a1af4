"""Catalogs of declared pieces and their consumers: derived joins and markdown indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORPHANED = "orphaned"


def with_consumers(catalog: DataFrame, uses: DataFrame, name: str = "name", software: str = "software", consumer: str = "consumer", status: str = "status") -> DataFrame:
    """The catalog with the sorted consumers of active uses, or `orphaned`."""
    live = uses.where(F.col(status) == "active").groupBy(F.col(software).alias("_software")).agg(F.array_join(F.array_sort(F.collect_list(consumer)), ", ").alias("consumers"))
    return catalog.join(live, F.col(name) == F.col("_software"), "left").drop("_software").withColumn("consumers", F.coalesce("consumers", F.lit(ORPHANED)))


def release_faults(catalog: DataFrame, packages: DataFrame) -> DataFrame:
    """Names that only one side has, and releases that are not name-v<version>: name, fault."""
    both = catalog.select("name", "release").join(packages.select("name", "version"), "name", "full")
    fault = F.when(F.col("release").isNull(), "not in catalog").when(F.col("version").isNull(), "not on disk").when(F.col("release") != F.concat("name", F.lit("-v"), "version"), "stale release")
    return both.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def index_text(rows: DataFrame, columns: list[str], order: list[str], titles: list[str]) -> DataFrame:
    """One markdown table over a small catalog, rows in order."""
    from millrace.operators.wire import markdown_rows

    lines = rows.select(F.struct(*order, markdown_rows(rows, columns).alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rows"))
    head = "| " + " | ".join(titles) + " |\n| " + " | ".join("---" for _ in titles) + " |\n"
    return lines.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\n"))), "")).alias("index"))


def is_fresh(derived: str, stored: str) -> bool:
    """Whether a stored index equals the derived one."""
    return derived == stored
