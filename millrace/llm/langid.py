"""Language identification by error-correcting output codes.

Each known language has a codeword of bits; one binary classifier per bit, linear over hashed character
n-grams, predicts that bit; loss-weighted decoding then picks the codeword with the least weighted loss and
the gap to the runner-up flags ambiguous texts.

Training reads a bounded sample of labelled rows: about SAMPLE_PER_LANGUAGE a language and SAMPLE_TOTAL in
all, never more than twice that, chosen by a hash of doc_id and text over the whole table.  Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0 and no ambiguity; without any
labelled row every text is `und`, and `keep_identified` fails rather than drop texts that have letters; a null doc_id is never held out and never trained on; repeated rows give
repeated rows; ties between codewords go to the first language by code point; extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, spread

DIM = 4096
SAMPLE_PER_LANGUAGE = 300
SAMPLE_TOTAL = 2400
RIDGE = 0.01
#: Least relative gap between the losses of the two best codewords below which a text is ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
#: Letters and spaces of a text that are hashed at a time.
PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams over the lower-cased letters, runs of anything else as one space; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, points, 32)[keep].astype(np.uint32)
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    total = np.zeros(DIM, np.int64)
    for at in range(0, len(c) - 1, PIECE):
        p = c[at : at + PIECE + 2]
        one = p * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (p[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (p[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for h in (one[:PIECE], two[:PIECE], three[:PIECE]):
            total += np.bincount(h >> np.uint32(20), minlength=DIM)
    return total


def features(total: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies, a vector of length 1."""
    return np.sqrt(total / total.sum()).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1 bits: all distinct splits for up to 6 languages, else the seeded random code of largest distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 - 2 * int(s >> i & 1) for s in splits] for i in range(n)], float)
    width = max(15, int(np.ceil(10 * np.log2(n))))
    best, most = None, -1
    rng = np.random.default_rng(20)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        least = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if least > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, least
    return best if best is not None else code


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For feature rows: index of the language, score in 0..1, whether it is ambiguous."""
        margins = np.clip(x @ self.weights, -3, 3)
        loss = (self.bit_weight * np.log1p(np.exp(-4 * self.code[None] * margins[:, None, :]))).sum(2)
        best = loss.argmin(1)
        if len(self.languages) == 1:
            return best, np.ones(len(x)), np.zeros(len(x), bool)
        two = np.partition(loss, 1, axis=1)
        sharp = np.exp(-2 * (loss - two[:, :1]))
        return best, 1 / sharp.sum(1), (two[:, 1] - two[:, 0]) < AMBIGUOUS * np.maximum(two[:, 1], 1e-9)


def trained(languages: list[str], labels: np.ndarray, x: np.ndarray) -> Model:
    """Ridge regression of every code bit in its dual form; a bit weighs by its mean margin over the sample."""
    code = codewords(len(languages))
    y = code[labels]
    gram = x.astype(float) @ x.T.astype(float)
    weights = x.T.astype(float) @ np.linalg.solve(gram + RIDGE * np.eye(len(x)), y)
    edge = np.clip(((x @ weights) * y).mean(0), 0.05, 1)
    return Model(languages, code, weights.astype(np.float32), edge / edge.sum())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, c, h) for lang, text, h in zip(*(batch.column(k).to_pylist() for k in ("lang", "text", "h")), strict=True) if (c := counts(text)) is not None]
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([zlib.compress(features(r[1]).tobytes(), 1) for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "x", "h"])


def fit(docs: DataFrame) -> Model | None:
    """Learns from the labelled documents that are not held out."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = min(SAMPLE_PER_LANGUAGE, max(4, SAMPLE_TOTAL // len(sizes)))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 1.2 * each / n))])
    hashed = usable.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(6)), F.lit(1 << 30)))
    drawn = hashed.where(F.col("h") < share[F.col("lang")] * float(1 << 30)).select("lang", "text", "h")
    rows = drawn.mapInArrow(lean(_sampled), "lang string, x binary, h long").orderBy("h", "lang", "x").limit(2 * SAMPLE_TOTAL).collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    languages = sorted({r[0] for r in rows})
    x = np.stack([np.frombuffer(zlib.decompress(r[1]), np.float32) for r in rows])
    return trained(languages, np.array([languages.index(r[0]) for r in rows]), x)


def decide(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language, score and ambiguity of each text."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
    if model is None:
        return out
    for at in range(0, len(texts), 256):
        found = [(i, features(c)) for i in range(at, min(at + 256, len(texts))) if (c := counts(texts[i])) is not None]
        if found:
            for (i, _), best, score, unsure in zip(found, *model.decode(np.stack([x for _, x in found])), strict=True):
                out[i] = (model.languages[best], float(score), bool(unsure))
    return out


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = decide(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return spread(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")).mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns as they were, whose language is known and not ambiguous.  No shuffle.

    Without a model, documents without a letter go as ever; the first one with a letter fails the job.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            if model is None and any(counts(t) is not None for t in texts):
                raise ValueError("no labelled document to learn languages from: nothing could be kept")
            got = decide(model, texts)
            yield batch.filter(pa.array([lang != UNKNOWN and not unsure for lang, _, unsure in got], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
