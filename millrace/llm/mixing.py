"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of all words by weight, stopped at `cap` times its own words, the excess
reshared by weight.  A document's expected copies are target / words of its source (times its own relative
weight, if a weight column is given); the whole part is allotted for certain, and the rest is a fixed-size
sample: documents are ranked by the random odds u/(1-u) over their inclusion odds p/(1-p), and the first of
the ranking are taken until the words still due are met as nearly as a whole document allows.

No source is ever gathered in one task: the ranking's cut is found by two rounds of 512 histogram cells a
source, and only the documents of the one cell that holds the cut are ordered.

Defined cases: null or empty text has size 0 and nothing is taken; the null source is a source of its own
and comes last; a source without words has target 0; repeated rows are separate documents that rank side by
side; a null doc_id ranks first among ties; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD_PATTERN, running_start, scratch, sized, spread, staged

CELLS = 512
#: Fixed by contract: weights by rank of the source, repeating, and the most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3


def words_of(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From rows (source, words): adds weight and target.  One pass over the sources a round; only sums reach the driver."""
    ranked = staged(
        running_start(sizes.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], "_one", "_rank")
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
        .drop("_one", "_rank"),
        "sources",
    )
    total, weight = ranked.agg(F.sum("words"), F.sum("weight")).first()
    level = (total or 0) / (weight or 1)
    while True:
        full = cap * F.col("words") <= level * F.col("weight")
        stopped, free = ranked.agg(F.sum(F.when(full, cap * F.col("words")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or (total - stopped) / free <= level * (1 + 1e-15):
            break
        level = (total - stopped) / free
    return ranked.withColumn("target", F.least(F.lit(float(cap)) * F.col("words"), F.lit(float(level)) * F.col("weight")))


def _ranked(rows: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """Rows (source, size, u, w, ..) with key, source_size, target, the whole copies allotted and the place v in the ranking for one more."""
    expected = F.when((F.col("source_size") > 0) & (F.col("weighted") > 0), F.least(F.lit(float(cap)), F.col("target") * F.col("w") / F.col("weighted"))).otherwise(0.0)
    return (
        rows.withColumn("key", _key("source"))
        .join(sized(known), "key")
        .withColumn("e", expected)
        .withColumn("whole", F.floor("e"))
        .withColumn("p", F.col("e") - F.col("whole"))
        .withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("v", F.col("q") / (1 + F.col("q")))
        .drop("w", "u", "e", "p", "q", "weighted", "source")
    )


def _with_copies(ranked: DataFrame, cut: DataFrame) -> DataFrame:
    """The copies of each row, from its own columns and its source's cut."""
    more = F.col("v").isNotNull() & F.col("cut_v").isNotNull() & ((F.col("v") < F.col("cut_v")) | (F.col("v") == F.col("cut_v")) & (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) <= F.col("cut_id")))
    return ranked.join(sized(cut), "key", "left").withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long"))


def _drawn(docs: DataFrame, weight_col: str | None, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size, the random number u of the doc_id, the weight w, and more columns."""
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 52))
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(F.col("doc_id").cast("long"), "source", words_of().alias("size"), ((unit + 0.5) / float(1 << 52)).alias("u"), weight.alias("w"), *more)


def _planned(docs: DataFrame, weight_col: str | None, seed: int, cap: int, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the documents' sizes, the sources' targets and the sources' cuts."""
    with scratch():
        needed = spread(docs.select("doc_id", "source", "text", *([weight_col] if weight_col else [])))
        base = staged(_drawn(needed, weight_col, seed), "sized", keep=True)
        sources = targets(base.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.col("w") * F.col("size")).alias("weighted")), weights, cap)
        known = staged(sources.select(_key("source").alias("key"), F.col("words").alias("source_size"), "target", "weighted"), "targets", keep=True)
        ranked = _ranked(base, known, cap)
        due = ranked.groupBy("key").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("due"))
        return base, known, staged(_cuts(ranked, staged(due, "due")), "cuts", keep=True)


def mixed(docs: DataFrame, weight_col: str | None = None, seed: int = 3, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies."""
    base, known, cut = _planned(docs, weight_col, seed, cap, weights)
    return _with_copies(_ranked(base, known, cap), cut).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _cuts(ranked: DataFrame, due: DataFrame) -> DataFrame:
    """Per source the last document of the ranking that is taken: key, cut_v, cut_id; no row where none is."""
    one = F.least(F.floor(F.col("v") * CELLS), F.lit(CELLS - 1))
    two = F.least(F.floor((F.col("v") * CELLS - F.col("c1")) * CELLS), F.lit(CELLS - 1))
    rows = ranked.where("v IS NOT NULL").select("key", "doc_id", "size", "v").withColumn("c1", one).withColumn("c2", two)
    at = due.withColumn("before", F.lit(0.0))
    for cell, same in (("c1", []), ("c2", ["c1"])):
        inside = rows if not same else rows.join(sized(at).select("key", *same), ["key", *same])
        # Written first: else the window's partitioning by source would gather each task's cells of a source in one task.
        sums = staged(inside.groupBy("key", cell).agg(F.sum("size").alias("words")), "cells")
        order = Window.partitionBy("key").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.join(at, "key").withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(order), F.lit(0)))
        # The cell that holds the last word due; beyond all cells, the last one.
        held = sums.where(F.col("start") < F.col("due")).groupBy("key").agg(F.max_by(F.struct(cell, "start", "due", *same), F.col(cell)).alias("m"))
        at = staged(held.select("key", *[F.col(f"m.{c}").alias(c) for c in (*same, cell, "due")], F.col("m.start").alias("before")), "cut")
    last = rows.join(sized(at), ["key", "c1", "c2"])
    order = Window.partitionBy("key").orderBy("v", "doc_id", "size")
    last = last.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    last = last.withColumn("end", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Taken up to the document whose end is nearest to the words due; the end of the cells before counts as a choice.
    gap = F.abs(F.col("end") - F.col("due"))
    best = last.groupBy("key").agg(F.min_by(F.struct("v", "id"), F.struct(gap, "end")).alias("b"), F.min(gap).alias("gap"), F.max(F.col("due") - F.col("before")).alias("stay"), F.min("v").alias("first"))
    taken = F.col("gap") <= F.col("stay")
    # Not taking any of the last cell still takes what ranks before its first document.
    return best.select("key", F.when(taken, F.col("b.v")).otherwise(F.col("first")).alias("cut_v"), F.when(taken, F.col("b.id")).otherwise(F.lit(-(1 << 63))).alias("cut_id"))


def copied(docs: DataFrame, seed: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as they were.

    A row's copies follow from its own columns and its source's cut, so whole rows are not shuffled.
    """
    _, known, cut = _planned(docs, None, seed, CAP, WEIGHTS)
    rows = _with_copies(_ranked(_drawn(docs, None, seed, F.struct("*").alias("_row")), known, CAP), cut).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
