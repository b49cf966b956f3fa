"""Sparse structs: columns of any schema rewritten so that what says nothing is null, which to_json leaves out.

The rewriting follows the schema, not the rows: expressions for each field, nothing per value in Python. A struct
can't tell a null from a missing entry, so nulls are left out like missing ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

#: How long texts and lists may be.
TEXT, NESTED_TEXT, ENTRIES = 240, 120, 5
_MOMENTS = (DateType, TimestampType, TimestampNTZType)


def without_empty(c: Column, kind: StructType) -> Column:
    """The struct with empty texts and false as null; 0 and empty lists stay."""

    def entry(f) -> Column:
        x = c[f.name]
        if isinstance(f.dataType, StringType):
            return F.when(x != "", x)
        return F.when(x, x) if isinstance(f.dataType, BooleanType) else x

    return F.when(c.isNotNull(), F.struct(*(entry(f).alias(f.name) for f in kind.fields)))


def _cut(c: Column, n: int) -> Column:
    return F.left(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(n))


def _is_plain(kind: DataType) -> bool:
    return isinstance(kind, (StringType, NumericType, BooleanType))


def _plain(c: Column, kind: DataType, n: int) -> Column:
    return _cut(c, n) if isinstance(kind, StringType) else c


def _flat(c: Column, kind: StructType) -> Column | None:
    """A nested struct's plain fields; none where its schema has no such field."""
    fields = [f for f in kind.fields if _is_plain(f.dataType)]
    return F.struct(*(_plain(c[f.name], f.dataType, NESTED_TEXT).alias(f.name) for f in fields)) if fields else None


def _entry(c: Column, kind: DataType) -> Column | None:
    if _is_plain(kind):
        return _plain(c, kind, TEXT)
    if isinstance(kind, _MOMENTS):
        return c
    if isinstance(kind, StructType):
        flat = _flat(c, kind)
        if flat is None:
            return None
        return F.when(F.coalesce(*(c[f.name].cast("string") for f in kind.fields if _is_plain(f.dataType))).isNotNull(), flat)
    if isinstance(kind, MapType) and _is_plain(kind.valueType):
        return F.when(F.size(c) > 0, F.transform_values(c, lambda _, v: _plain(v, kind.valueType, NESTED_TEXT)))
    if isinstance(kind, ArrayType):
        of = kind.elementType
        if isinstance(of, StringType):
            items = F.filter(F.transform(c, lambda x: _cut(x, NESTED_TEXT)), lambda x: x != "")
        elif isinstance(of, StructType) and any(_is_plain(f.dataType) for f in of.fields):
            items = F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: _flat(x, of))
        else:
            return None
        items = F.slice(items, 1, ENTRIES)
        return F.when(F.size(items) > 0, items)
    return None


def compacted(c: Column, kind: StructType) -> Column:
    """A payload to be stored: texts cut to TEXT, in lists and nested structs to NESTED_TEXT; lists of texts or structs cut to
    ENTRIES, empty texts and nulls in them left out; of nested structs and maps the texts, numbers and truth values; what
    is nested deeper, lists of numbers, empty lists and structs are left out."""
    entries = [(f.name, _entry(c[f.name], f.dataType)) for f in kind.fields]
    kept = [x.alias(name) for name, x in entries if x is not None]
    return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
