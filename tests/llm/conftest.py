"""Awkward documents shared by the tests of this folder."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, cls long, start long, p int, row string, id long, copies int, digest string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def rows() -> list[tuple]:
    base = words(1, 120)
    texts = [
        base, base, base.replace(" ", "\n", 3), base + " tail word", words(2, 90), words(3, 300), None, "", " \n\t ", "one", "two words", "a b c d e", "A B C D E", "<|endoftext|> x",
        "é́ Σς İ ﬁ … naïve, 3.14.", words(4, 40) * 2000, "x" * 200_000, "same line\n" * 80, "%%% $$$ ### word " * 30, words(2, 90), base[: len(base) * 9 // 10],
    ]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or ""), 7, "k", 1, 2, 3, "r", 4, 9, "d"))
    out.append(out[3])  # a repeated row
    out.append((None, base, "en", "s1", 1, 7, "k", 1, 2, 3, "r", 4, 9, "d"))
    out.append((None, None, None, None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
