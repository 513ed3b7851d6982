"""Walks over nested values: expressions made from a column's type, as deep as it goes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: keys that name contacts or forms that people signed.
CONTACTS = r"(?i)(?:e[ -]?mail|phone|contact|address|waiver|registrant)"


def _scrubbed(value: Column, kind: T.DataType, pattern: str) -> Column | None:
    if isinstance(kind, T.StructType):
        fields = [(f.name, _scrubbed(value[f.name], f.dataType, pattern)) for f in kind if not re.search(pattern, f.name)]
        kept = [x.alias(name) for name, x in fields if x is not None]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, T.ArrayType):
        if _scrubbed(value, kind.elementType, pattern) is None:
            return None
        return F.transform(value, lambda x: _scrubbed(x, kind.elementType, pattern))
    if isinstance(kind, T.MapType):
        if _scrubbed(value, kind.valueType, pattern) is None:
            return None
        kept = F.map_filter(value, lambda k, v: ~k.rlike(pattern)) if isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(kept, lambda k, v: _scrubbed(v, kind.valueType, pattern))
    return value


def scrub(df: DataFrame, *columns: str, pattern: str = CONTACTS) -> DataFrame:
    """``df`` without fields and keys that the pattern names, at any depth of ``columns`` (all if none is given).

    Fields of structs go from the type, keys of maps from each row; a struct of which no
    field stays goes as well. Other columns stay as they are.
    """
    walked = columns or df.columns
    out = []
    for f in df.schema:
        own = F.col(f"`{f.name}`")
        if f.name in walked:
            own = None if re.search(pattern, f.name) else _scrubbed(own, f.dataType, pattern)
        if own is not None:
            out.append(own.alias(f.name))
    return df.select(*out)


_CELL = "array<struct<place:string,value:string>>"


def _strings(value: Column, kind: T.DataType, place: Column) -> Column | None:
    none = F.array().cast(_CELL)
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(place.alias("place"), value.alias("value")))).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [x for f in kind if (x := _strings(value[f.name], f.dataType, F.concat(place, F.lit(f".{f.name}")))) is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _strings(value, kind.elementType, place) is None:
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: _strings(x, kind.elementType, F.concat(place, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if isinstance(kind, T.MapType):
        if _strings(value, kind.valueType, place) is None:
            return None
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), lambda e: _strings(e["value"], kind.valueType, F.concat(place, F.lit("."), e["key"].cast("string"))))), none)
    return None


def harvest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, place, value): every string in ``columns``, at any depth, with its path; keys of maps are no values."""
    found = [x for c in columns if (x := _strings(F.col(c), df.schema[c].dataType, F.lit(c))) is not None]
    return df.select(key, F.explode(F.concat(*found) if found else F.array().cast(_CELL)).alias("cell")).select(key, "cell.*")
