"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package even where the driver added it to sys.path by hand."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if str(ROOT) not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else str(ROOT)
    return spark
