"""Rows as line-oriented text: cells, tables, pages and envelopes, planned from the schema alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.native import escaped_cell

JSON, TSV, PAGE, ENVELOPE = "json", "tsv", "page-tsv", "envelope"


@dataclass(frozen=True)
class Plan:
    """How a value is encoded: kind, and for an envelope the fields that become tables."""

    kind: str
    tsv_fields: tuple[str, ...] = ()


def _flat(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and all(not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType) for f in kind.fields)


def _table(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and _flat(kind.elementType)


def plan(kind: T.DataType) -> Plan:
    """A list of flat rows is a table; a struct with such `items` and `next_cursor` is a page; other structs with such fields are envelopes."""
    if _table(kind):
        return Plan(TSV)
    if isinstance(kind, T.StructType):
        fields = tuple(f.name for f in kind.fields if _table(f.dataType))
        if fields == ("items",) and "next_cursor" in kind.fieldNames():
            return Plan(PAGE)
        if fields:
            return Plan(ENVELOPE, fields)
    return Plan(JSON)


def cell(value: Column, kind: T.DataType) -> Column:
    """One cell: null is empty, booleans True or False, nested values compact JSON, texts escaped.

    Doubles print as Spark does, which differs from Python beyond 10^7 and below 10^-3.
    """
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "True").otherwise(F.when(value.isNotNull(), "False"))
    elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        text = escaped_cell(F.to_json(value, {"ignoreNullFields": "false"}))
    elif isinstance(kind, T.StringType):
        text = escaped_cell(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def line(df: DataFrame, columns: list[str]) -> Column:
    """One row as a line without its end."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("\t", *[cell(F.col(c), kinds[c]) if c in kinds else F.lit("") for c in columns])


def header(columns: list[str]) -> str:
    for raw, safe in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        columns = [c.replace(raw, safe) for c in columns]
    return "\t".join(columns) + "\n"


def tables(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """One table text for each group, rows in the given order; the text of a group is one value by nature."""
    keys = F.struct(*[F.col(o).alias(f"k{i}") for i, o in enumerate(order)], line(df, columns).alias("line"))
    grouped = df.select(*by, keys.alias("r")).groupBy(*by).agg(F.sort_array(F.collect_list("r")).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["line"], F.lit("\n"))), "")
    return grouped.select(*by, F.concat(F.lit(header(columns)), body).alias("tsv"))


def array_table(rows: Column, kind: T.ArrayType) -> Column:
    """An array of flat structs as a table text; the empty array gives a lone line end."""
    fields = kind.elementType.fields
    lines = F.transform(rows, lambda r: F.concat(F.concat_ws("\t", *[cell(r[f.name], f.dataType) for f in fields]), F.lit("\n")))
    return F.when(F.size(rows) == 0, F.lit("\n")).otherwise(F.concat(F.lit(header([f.name for f in fields])), F.array_join(lines, "")))


def envelope(fields: dict[str, tuple[Column, T.DataType]], tsv_fields: tuple[str, ...]) -> Column:
    """Named values as JSON text, those of tsv_fields as tables with their format beside them.

    A null field stays out with its format. A text counts as a finished table. A list of other things than rows stays
    JSON, unless it is empty; what is no list at all becomes the empty table.
    """
    written, marks = [], {}
    for name, (value, kind) in fields.items():
        there, text = value.isNotNull(), value
        if name not in tsv_fields or isinstance(kind, T.StringType):
            written.append(value.alias(name))
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            there = F.size(value) == 0
            written += [F.when(there, "\n").alias(name), F.when(~there, value).alias(name)]
        else:
            text = array_table(value, kind) if isinstance(kind, T.ArrayType) else F.lit("\n")
            written.append(F.when(there, text).alias(name))
        marks[name] = F.when(there, TSV).alias(f"_{name}_format")
    return F.to_json(F.struct(*written, *[marks[n] for n in tsv_fields if n in marks]))


def encoded(df: DataFrame, names: list[str], tsv_fields: tuple[str, ...]) -> Column:
    """Columns as an envelope."""
    return envelope({n: (F.col(n), df.schema[n].dataType) for n in names}, tsv_fields)


def json_text(value: Column, kind: T.DataType) -> Column:
    """A value as compact JSON; null fields of structs stay out."""
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(value)
    boxed = F.to_json(F.array(value))
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def rendered(value: Column, kind: T.DataType, consumer: Column, chosen: Plan | None = None) -> Column:
    """A value as text, format and structured JSON for a consumer: compressed by its plan for `llm`, plain JSON for all others.

    Only a bare table has the format tsv; pages and envelopes are JSON around tables. A plan that does not fit the type gives JSON.
    """
    chosen = chosen or plan(kind)
    plain = json_text(value, kind)
    compact, name = plain, JSON
    if chosen.kind == TSV:
        compact, name = array_table(value, kind) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else F.lit("\n"), TSV
    elif chosen.kind in (PAGE, ENVELOPE) and isinstance(kind, T.StructType):
        tables_in = ("items",) if chosen.kind == PAGE else chosen.tsv_fields
        compact = envelope({f.name: (value[f.name], f.dataType) for f in kind.fields}, tables_in)
    llm = consumer == "llm"
    return F.struct(F.when(llm, compact).otherwise(plain).alias("text"), F.when(llm, name).otherwise(JSON).alias("format"), plain.alias("structured"))


def pruned(value: Column, kind: T.DataType, inner: bool = True) -> Column:
    """A value whose structs lose null and empty fields at every depth, from the inside out; false and 0 stay.

    Empty fields become null, which `json_text` leaves out. Elements of a list stay, pruned, even when nothing is left of them.
    """
    if isinstance(kind, T.StructType):
        fields = [pruned(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        left = reduce(or_, [f.isNotNull() for f in fields], F.lit(not inner))
        return F.when(left & value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(value) > 0, F.transform(value, lambda x: pruned(x, kind.elementType, inner=False)) if isinstance(kind.elementType, T.StructType) else value)
    if isinstance(kind, T.MapType):
        return F.when(F.size(value) > 0, value)
    return F.when(value != "", value) if isinstance(kind, T.StringType) else value


def first_seen_columns(rows: DataFrame, fields: str, position: str) -> DataFrame:
    """Keys of a map column over all rows in the order they are first met: column, place."""
    keys = rows.select(F.col(position).alias("row"), F.posexplode(F.map_keys(fields)).alias("at", "column"))
    met = keys.groupBy("column").agg(F.min(F.struct("row", "at")).alias("place"))
    return met.select("column", "place.row", "place.at")


def sparse_lines(rows: DataFrame, fields: str, position: str, columns: list[str]) -> DataFrame:
    """Rows of a string map as lines under a header of all columns; a key that a row lacks is an empty cell."""
    cells = [F.coalesce(escaped_cell(F.element_at(F.col(fields), F.lit(c))), F.lit("")) for c in columns]
    return rows.select(F.col(position), F.concat_ws("\t", *cells).alias("line"))


def sparse_table(rows: DataFrame, fields: str, position: str) -> DataFrame:
    """Rows of a string map as one table: position, header and line, the header of all keys in the order they are first met.

    The header is one row, as long as there are distinct keys, and goes to every task.
    """
    met = first_seen_columns(rows, fields, position).select(F.struct("row", "at", "column").alias("c"))
    head = met.agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["column"]).alias("_columns"))
    head = head.withColumn("header", F.array_join(F.transform("_columns", escaped_cell), "\t"))
    cells = F.transform("_columns", lambda c: F.coalesce(escaped_cell(F.element_at(F.col(fields), c)), F.lit("")))
    return rows.select(position, fields).crossJoin(F.broadcast(head)).select(position, "header", F.array_join(cells, "\t").alias("line"))  # by one row


def viewed(value: Column, kind: T.DataType, fields: list[str], page_size: int | None = None) -> Column:
    """The listed fields that exist and the first rows of a list of rows; any other value passes as it is."""
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        return value
    cut = F.slice(value, 1, page_size) if page_size is not None and page_size > 0 else value
    kept = [f for f in fields if f in kind.elementType.names]
    return F.transform(cut, lambda r: F.struct(*[r[f].alias(f) for f in kept]) if kept else F.create_map().cast("map<string,string>")) if fields else cut


def list_view(df: DataFrame, fields: list[str], order: list[Column], page_size: int | None = None) -> DataFrame:
    """The listed fields that exist, in that order, and the first rows of a given order."""
    kept = df
    if page_size is not None and page_size > 0:
        kept = kept.orderBy(*order).limit(page_size)
    return kept.select(*[f for f in fields if f in df.columns]) if fields else kept


def short_marker(result: Column, is_list: Column, kind: Column) -> Column:
    """What stands for a structured result: its number of items, its type, or a placeholder. result: number of items."""
    return F.when(is_list, F.concat(F.lit("["), result.cast("string"), F.lit(" item(s)]"))).when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("<"), kind, F.lit(">"))).otherwise("(see structuredContent)")


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """A row of a markdown table: bars escaped, line ends as spaces, null as nothing."""
    one = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(one, columns)), F.lit(" |"))
