"""Token totals, prices by model and cost policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.native import token_cost

USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def token_totals(usage: DataFrame) -> DataFrame:
    """Adds prompt_total (fresh, written and read tokens); missing counts are 0."""
    counts = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in usage.columns else F.lit(0).cast("long") for c in USAGE}
    return usage.withColumns(counts).withColumn("prompt_total", F.col(USAGE[0]) + F.col(USAGE[1]) + F.col(USAGE[2]))


def priced(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Adds cost_usd: a model's own price, else that of the first listed model whose name its name begins with, else 0.

    prices: place, known, input, output (per million tokens).  Each distinct model is joined by the beginnings of its name, as equal keys.
    """
    models = usage.select(F.col(model).alias("_model")).distinct()
    beginnings = F.transform(F.sequence(F.lit(0), F.length("_model")), lambda n: F.substring(F.col("_model"), F.lit(1), n))
    best = models.select("_model", F.explode(beginnings).alias("known")).join(prices, "known").groupBy("_model").agg(F.min_by(F.struct("input", "output"), F.struct(F.col("_model") != F.col("known"), F.col("place"))).alias("_price"))
    total = token_totals(usage).join(best, F.col(model) == F.col("_model"), "left").drop("_model")
    c = [F.col(x) for x in USAGE]
    return total.withColumn("cost_usd", token_cost(*c, F.col("_price.input"), F.col("_price.output"))).drop("_price")


def _glob(pattern: Column) -> Column:
    """A file-name pattern as a regular expression over the whole text."""
    quoted = F.regexp_replace(pattern, r"([\\.+^${}()|])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[(?!!?\]?[^\]]*\])", r"\\[")  # a bracket without end stands for itself
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit(r"\z"))


def permitted(calls: DataFrame, policy: DataFrame, provider: str = "provider", model: str = "model") -> DataFrame:
    """Adds `permitted`: whether the lower-cased model fits a pattern allowed for its provider; unlisted providers are denied. policy: provider, pattern."""
    pairs = calls.select(F.col(provider).alias("_p"), F.lower(F.coalesce(F.col(model), F.lit(""))).alias("_m")).distinct()
    rules = policy.select(F.col("provider").alias("_rp"), _glob(F.col("pattern")).alias("_re"))
    allowed = pairs.join(rules, (F.col("_p") == F.col("_rp")) & F.expr("_m RLIKE _re")).select("_p", "_m").distinct().withColumn("permitted", F.lit(True))
    on = (F.col(provider) == F.col("_p")) & (F.lower(F.coalesce(F.col(model), F.lit(""))) == F.col("_m"))
    return calls.join(allowed, on, "left").drop("_p", "_m").withColumn("permitted", F.coalesce("permitted", F.lit(False)))
