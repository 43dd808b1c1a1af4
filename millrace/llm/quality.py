"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document and leaves one failure bit beside the measurements it used.
A policy is a versioned mask over those bits, so policies can be changed, compared and ablated without
another pass over the texts: `ablation` counts documents by masked bits (at most 2^rules groups) and derives
what each rule alone removes.

Defined cases: a null or empty text measures 0 everywhere and fails `too_few_words`; a document is one row
of input, repeated rows give repeated rows; extra columns of the input are ignored; texts of any length are
read whole; an empty table gives an empty ledger.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, lean, spread, staged
from millrace.llm.ngramjoin import keyed, without

#: Fixed by contract: characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_letter_words")

#: Rules in bit order: name and failure condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)"),
    ("duplicate_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("upper_case", "2 * n_upper > n_letters"),
    ("shouting", "100 * n_shouts > 30 * n_words"),
    ("few_letter_words", "100 * n_letter_words < 70 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]

#: Versioned policies: masks over the rule bits.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbol_ratio"] | BIT["word_length"] | BIT["few_letter_words"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"


def repeat_words(words: list[str]) -> int:
    """Words that stand in a window of three words found at least twice in the text, first finds included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    k = len(known)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # the product would not fit 64 bits: number the pairs first
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= hit
    return int(covered.sum())


@functools.cache
def letter_kinds() -> np.ndarray:
    """For each code point: 0 no letter, 1 letter, 2 upper-case letter."""
    points = map(chr, range(0x110000))
    return np.fromiter((c.isalpha() + (c.isalpha() and c.isupper()) for c in points), np.uint8, 0x110000)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    n_lines = 0
    for line in lines:
        if WORD.search(line):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    joined = "".join(words)
    kinds = letter_kinds()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return (
        len(words),
        len(joined),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(words),
        n_lines,
        int(np.count_nonzero(kinds)),
        int(np.count_nonzero(kinds == 2)),
        sum(w.endswith("!!") for w in words) if "!!" in text else 0,
        sum(map(_has_letter, words)),
    )


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])


def fail_bits() -> Column:
    """The failure bits of all rules over the measurement columns."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, every measurement, fail_bits."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lean(_measured), schema).withColumn("fail_bits", fail_bits())


def passes(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The stored ledger with the base verdict and that of a policy, which always includes the base rules."""
    return staged(ledger(docs), "ledger", keep=True).select("*", (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), (passes(F.col("fail_bits"), policy) & passes(F.col("fail_bits"), "base")).alias("kept"))


def ablation(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept were the rule left out."""
    mask = POLICIES[policy]
    groups = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if mask & BIT[name]])
    n = F.col("n")
    return (
        groups.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), n).otherwise(0)).alias("failing_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, n).otherwise(0)).alias("kept_without"),
        )
    )


def recorded(docs: DataFrame, *names: Column) -> DataFrame:
    """The ledger columns of each document, measurements and fail_bits, beside columns that name it."""

    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            columns = list(zip(*map(measure, texts.to_pylist()), strict=True)) or [()] * len(MEASURES)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    made = F.arrow_udf(lean(measured), ", ".join(f"{m} long" for m in MEASURES))
    rows = docs.select(*names, made(F.col("text")).alias("m"))
    return rows.select(*rows.columns[:-1], "m.*").withColumn("fail_bits", fail_bits())


def keep_passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents, all columns as they were, that a policy keeps.

    The ledger is written with each row's file and place instead of its text, and those whose bits the policy's mask
    hits are left out of the documents' own scan.
    """
    docs, file, place = keyed(docs)
    stored = staged(recorded(docs, file.alias("file"), place.alias("place")), "ledger", keep=True)
    return without(docs, file, place, stored.where(~(passes(F.col("fail_bits"), policy) & passes(F.col("fail_bits"), "base"))).select("file", "place"))
