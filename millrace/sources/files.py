"""Files as tables: TOML directories, documents by kind, and small text sinks."""

from __future__ import annotations

import os
import tempfile
import tomllib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Engines by file suffix; only HTML is built in, the others are seams for callers' own engines.
ENGINES = {"pdf": "pdf", "docx": "docx", "pptx": "office", "xlsx": "sheet", "xls": "sheet", "html": "html", "htm": "html", "doc": "legacy", "ppt": "legacy"}


def toml_directory(spark: SparkSession, path: str, fields: dict[str, T.DataType]) -> DataFrame:
    """One row for each *.toml file of a directory: file name and the asked top-level fields; lists join by ", "."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [tomllib.loads(c.decode()) for c in batch.column("content").to_pylist()]
            columns = [pa.array([_field(p.get(n), isinstance(k, T.StringType)) for p in parsed], pa.string() if isinstance(k, T.StringType) else pa.int64()) for n, k in fields.items()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), *columns], names=["file", *fields])

    return files.mapInArrow(run, T.StructType([T.StructField("file", T.StringType()), *(T.StructField(n, k) for n, k in fields.items())]))


def _field(value: object, text: bool) -> object:
    if value is None or not text:
        return value
    return ", ".join(map(str, value)) if isinstance(value, list) else str(value)


def engine_for(path: Column) -> Column:
    """The engine of a document by its lower-cased suffix, null where there is none."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in ENGINES.items() for x in pair]), suffix)


#: A conversion: the text, the engine that made it or was tried last, and what went wrong.
CONVERTED = T.StructType([T.StructField(n, T.StringType()) for n in ("markdown", "engine", "fidelity")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("lost", "warnings")])


class ConversionError(Exception):
    """What an engine raises for a document that it can't convert; any other exception fails the task."""


def converter(chains: Mapping[str, Sequence[tuple[str, Callable[[bytes], str]]]]) -> Callable[[dict], dict]:
    """A row function over (path, content): the first engine of the suffix's chain that does not refuse.

    All refusing, or no chain for the suffix: an empty text, fidelity `failed`, lost `all`, and the reasons.
    What an engine gives has no fidelity yet; `native.grade` judges it.
    """

    def failed(engine: str, reasons: list[str]) -> dict:
        return {"markdown": "", "engine": engine, "fidelity": "failed", "lost": ["all"], "warnings": reasons}

    def run(row: dict) -> dict:
        suffix = Path(row["path"]).suffix.lower()
        refused: list[str] = []
        name = "none"
        for name, engine in chains.get(suffix[1:], ()):
            try:
                return {"markdown": engine(row["content"]), "engine": name, "fidelity": None, "lost": [], "warnings": []}
            except ConversionError as e:
                refused.append(str(e))
        return failed(name, refused or [f"unsupported_format:{suffix or 'none'}"])

    return run


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their engine: path, content, engine."""
    return spark.read.format("binaryFile").load(path).select("path", "content", engine_for(F.col("path")).alias("engine"))


def write_text(path: str | Path, text: str) -> None:
    """Writes one small text whole or not at all: a temporary file beside it, synced, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
