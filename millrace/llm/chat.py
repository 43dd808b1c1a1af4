"""Preference formatting with DataFrame functions only.

Two tables of turns, chosen and rejected, share a pair id.  The longest common prefix of turns is rendered
once as the prompt; what follows on either side is rendered as that side's completion with a mask that trains
assistant turns alone.  Rows at one place (pair, turn) are one turn, in order of (role, text); a turn is common where both sides
have the same rows there, repeated ones as often.

Texts cross the network once, to be rendered: rows of both sides, and rows that are on both, are dealt by
(pair, part) beside one narrow row of the pair's cut, which comes from counts and 64-bit hashes of each
place.  A part holds PART places, so no pair is gathered whole; a longer pair goes on in further rows
(`part`), and a part with more than CROWD rows at its places in further rows still (`piece`).

Masks are run lengths over the completion's characters: "1:57,0:20" trains 57 characters and skips 20.

Defined cases: rows without a pair id are left out; a null turn stands at -1, a null role is `unknown`, a
null text is empty; rows that repeat a place all stay; texts of any length are rendered whole; a side that is missing, or equal
to the other, gives an empty completion; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import running_start, sized, staged

PART = 1024
CROWD = 4096
TRAINED = "assistant"
CHOSEN, REJECTED, BOTH = 1, 2, 3
NEVER = (1 << 63) - 1


def turns(rows: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, turn, role, text of every row that has a pair id."""
    return rows.select(
        F.col(pair).cast("long").alias("pair_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("pair_id IS NOT NULL")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda p: rendered(p["role"], p["text"])), "")


def _mask(rows: Column) -> Column:
    run = lambda p: F.concat(F.when(p["role"] == TRAINED, "1:").otherwise("0:"), F.length(rendered(p["role"], p["text"])).cast("string"))
    return F.array_join(F.transform(rows, run), ",")


def _part() -> Column:
    return F.floor(F.greatest(F.col("turn"), F.lit(0)) / PART).cast("long").alias("part")


def _places(rows: DataFrame, *more: Column) -> DataFrame:
    """pair_id, turn and a hash of each row: what the two sides are compared by."""
    return rows.select("pair_id", "turn", F.xxhash64("role", "text").cast("decimal(20,0)").alias("h"), *more)


def cuts(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, cut from the places of both sides: the first turn where they differ, so that earlier ones are the longest common prefix.  Equal sides have no row."""
    columns = ["pair_id", "turn"]
    narrow = chosen.select(*columns, F.lit(1).alias("n"), "h").unionAll(rejected.select(*columns, F.lit(-1).alias("n"), (-F.col("h")).alias("h")))
    # Equal rows cancel out: a place differs where counts or sums of hashes are left over.
    differ = narrow.groupBy("pair_id", "turn").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where("n <> 0 OR h <> 0")
    return differ.groupBy("pair_id").agg(F.min("turn").alias("cut"))


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part, piece, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask from two tables made by `turns`."""
    cut = cuts(_places(chosen), _places(rejected)).select("pair_id", "cut", F.lit(None).cast("long").alias("last"))
    return assembled(chosen.withColumn("side", F.lit(CHOSEN)).unionByName(rejected.withColumn("side", F.lit(REJECTED))), cut)


def assembled(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Renders rows (pair_id, turn, role, text, side) of all sides by pairs (pair_id, cut, last).

    Without a row in `pairs` nothing is cut.  Where `last` is set, later rows are left out, and the
    assistant's rows there that stand on both sides are taken for chosen alone.
    """
    placed = rows.withColumn("part", _part()).withColumn("piece", F.lit(0).cast("long"))
    sizes = staged(placed.groupBy("pair_id", "part").agg(F.count("*").alias("n")), "parts")
    crowded = staged(sizes.where(F.col("n") > CROWD).select("pair_id", "part"), "crowded")
    pieces = sizes.select("pair_id", "part", F.lit(0).cast("long").alias("piece"))
    if not crowded.isEmpty():
        placed, pieces = _in_pieces(placed, sized(crowded), pieces)
    end = F.lit(NEVER)
    empty = F.lit(None).cast("string")
    marks = pairs.join(pieces, "pair_id").select("pair_id", "part", "piece", "cut", "last", F.lit(None).cast("long").alias("turn"), empty.alias("role"), empty.alias("text"), F.lit(None).cast("int").alias("side"))
    every = placed.select("pair_id", "part", "piece", F.lit(None).cast("long").alias("cut"), F.lit(None).cast("long").alias("last"), "turn", "role", "text", "side").unionAll(marks)
    held = every.groupBy("pair_id", "part", "piece").agg(
        F.coalesce(F.max("cut"), end).alias("cut"),
        F.coalesce(F.max("last"), end).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("side").isNotNull(), F.struct("turn", "role", "text", "side")))).alias("p"),
    )
    answer = lambda p: (p["turn"] == F.col("last")) & (p["role"] == TRAINED)
    first = F.filter("p", lambda p: (p["turn"] <= F.col("last")) & (p["side"] != REJECTED))
    second = F.filter("p", lambda p: (p["turn"] <= F.col("last")) & (p["turn"] >= F.col("cut")) & ((p["side"] == REJECTED) | (p["side"] == BOTH) & ~answer(p)))
    sides = held.select("pair_id", "part", "piece", "cut", first.alias("c"), second.alias("r")).where("size(c) + size(r) > 0")
    prompt, after = F.filter("c", lambda p: p["turn"] < F.col("cut")), F.filter("c", lambda p: p["turn"] >= F.col("cut"))
    return sides.select(
        "pair_id",
        "part",
        "piece",
        F.size(prompt).cast("long").alias("n_prompt_turns"),
        _joined(prompt).alias("prompt"),
        _joined(after).alias("chosen"),
        _mask(after).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def _in_pieces(placed: DataFrame, crowded: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deals the rows of crowded parts into pieces of PART rows, in their order; ranks come from ranges, not from one task a part."""
    order = [F.col(c) for c in ("pair_id", "part", "turn", "role", "text", "side")]
    many = placed.drop("piece").join(crowded, ["pair_id", "part"], "left_semi").withColumn("one", F.lit(1))
    ranked = staged(running_start(many, order, "one", "rank"), "crowd")
    first = ranked.groupBy("pair_id", "part").agg(F.min("rank").alias("first"))
    dealt = staged(ranked.join(sized(staged(first, "first")), ["pair_id", "part"]).withColumn("piece", F.floor((F.col("rank") - F.col("first")) / PART).cast("long")).select(placed.columns), "pieces")
    rest = placed.join(crowded, ["pair_id", "part"], "left_anti")
    return rest.unionByName(dealt), pieces.join(crowded, ["pair_id", "part"], "left_anti").unionByName(dealt.select("pair_id", "part", "piece").distinct())


def with_borrowed_answers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and pairs for `assembled` from one table of conversations.

    Chosen is each conversation up to its last assistant turn; rejected is the same with the assistant's
    rows of that turn replaced by the last answer of the conversation with the next id, or left out where
    there is no such conversation.  A conversation without an assistant turn is whole on both sides.  Of
    several assistant rows at the last turn the greatest text is the answer that is lent.  The cut of a pair
    is found by comparing its two sides turn by turn, as in `preferences`.
    """
    every = turns(rows)
    answers = every.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("a"))
    last = staged(answers.select("pair_id", F.col("a.turn").alias("last"), F.col("a.text").alias("text")), "answers")
    lent = last.select(F.try_subtract("pair_id", F.lit(1).cast("long")).alias("pair_id"), F.col("text").alias("lent"))
    known = staged(last.select("pair_id", "last").join(lent, "pair_id", "left"), "lent")
    borrowed = known.where("lent IS NOT NULL").select("pair_id", F.col("last").alias("turn"), F.lit(TRAINED).alias("role"), F.col("lent").alias("text"))
    ends = known.select("pair_id", "last")
    # Both sides as they stand, as hashes: a conversation without an answer is the same on both and needs no cut.
    placed = _places(every, (F.col("role") == TRAINED).alias("said")).join(ends, "pair_id").where(F.col("turn") <= F.col("last"))
    found = cuts(placed, placed.where(~(F.col("said") & (F.col("turn") == F.col("last")))).select("pair_id", "turn", "h").unionAll(_places(borrowed)))
    pairs = ends.join(found, "pair_id", "left").select("pair_id", "cut", "last")
    return every.withColumn("side", F.lit(BOTH)).unionByName(borrowed.withColumn("side", F.lit(REJECTED))), pairs
