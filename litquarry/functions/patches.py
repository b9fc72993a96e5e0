"""Patches of nested documents by paths like ``instruments[0].data_collection_periods[1].time_range``, at any depth of a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from litquarry.functions.parsers import path_tokens


def _is(tokens: Column, k: int, name: str) -> Column:
    return F.get(tokens, F.lit(k)) == name


def _index(tokens: Column, k: int) -> Column:
    """The number that a path has at a place, null for a name."""
    return F.get(tokens, F.lit(k)).try_cast("int")


def _given(value: Column, kind: DataType) -> Column:
    """The text of a new value as a ``kind``: JSON for what is nested, plain for the rest."""
    if isinstance(kind, StringType):
        return value
    return F.from_json(value, kind) if isinstance(kind, (StructType, ArrayType)) else value.try_cast(kind)


def _set(node: Column, kind: DataType, tokens: Column, k: int, value: Column) -> Column:
    """``node``, at depth ``k`` of the path, with the value set in it: the setter is written out from the schema."""
    inner = node
    if isinstance(kind, StructType):
        fields = [F.when(_is(tokens, k, f.name), _set(node[f.name], f.dataType, tokens, k + 1, value)).otherwise(node[f.name]).alias(f.name) for f in kind.fields]
        inner = F.when(node.isNotNull(), F.struct(*fields))
    elif isinstance(kind, ArrayType):
        inner = F.transform(node, lambda x, i: F.when(i == _index(tokens, k), _set(x, kind.elementType, tokens, k + 1, value)).otherwise(x))
    return F.when(F.size(tokens) == k, _given(value, kind)).otherwise(inner)


def _leads(node: Column, kind: DataType, tokens: Column, k: int) -> Column:
    """Whether the rest of a path from depth ``k`` on leads somewhere in ``node``."""
    further = F.lit(False)
    if isinstance(kind, StructType):
        for f in kind.fields:
            further = further | (_is(tokens, k, f.name) & _leads(node[f.name], f.dataType, tokens, k + 1))
        further = node.isNotNull() & further
    elif isinstance(kind, ArrayType):
        place = _index(tokens, k)
        further = (place < F.size(node)) & _leads(F.get(node, place), kind.elementType, tokens, k + 1)
    return (F.size(tokens) == k) | F.coalesce(further, F.lit(False))


def path_leads(document: Column, schema: StructType, path: Column) -> Column:
    """Whether a path names a field or an element that the document has; null elements and structs have no fields."""
    return F.coalesce(_leads(document, schema, path_tokens(path), 0), F.lit(False))


def apply_patch(document: Column, schema: StructType, path: Column, value: Column) -> Column:
    """``document`` with the text ``value`` at ``path``; nested values are JSON. A path that leads nowhere changes nothing.

    Values that can't be read as the field's type become null.
    """
    given = F.struct(document.alias("document"), path_tokens(path).alias("tokens"), value.alias("value"))

    def patched(x: Column) -> Column:
        leads = F.coalesce(_leads(x["document"], schema, x["tokens"], 0), F.lit(False))
        return F.when(leads, _set(x["document"], schema, x["tokens"], 0, x["value"])).otherwise(x["document"])

    # the setter names its path at every field: as the only element of an array, it is read once a row
    return F.get(F.transform(F.array(given), patched), F.lit(0))
