"""Dotted paths with indexes. A flat column of that very name wins over nested traversal; results are named by the whole path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

NAME = re.compile(r"^(?:[A-Za-z_][A-Za-z0-9_]*|[0-9]+)(?:\.(?:[A-Za-z_][A-Za-z0-9_]*|[0-9]+)|\[[0-9]+\])*$")
STEP = re.compile(r"\[([0-9]+)\]|([^.\[\]]+)")


def check_name(path: str) -> str:
    """The path itself, or an error where it is no column name (blanks, quotes, brackets other than an index)."""
    if len(path) > 256 or not NAME.match(path):
        raise ValueError(f"not a column name: {path!r}")
    return path


def steps(path: str) -> list[str | int]:
    """a.b[0] as a, b, 0."""
    return [int(i) if i else name for i, name in STEP.findall(path)]


def kind_of(schema: StructType, path: str) -> DataType | None:
    """The type of a path, or None where it leads nowhere."""
    if path in schema.fieldNames():
        return schema[path].dataType
    kind: DataType = schema
    for step in steps(path):
        if isinstance(step, int):
            kind = kind.elementType if isinstance(kind, ArrayType) else None
        elif isinstance(kind, StructType) and step in kind.fieldNames():
            kind = kind[step].dataType
        elif isinstance(kind, MapType):
            kind = kind.valueType
        else:
            kind = None
        if kind is None:
            return None
    return kind


def has_path(df: DataFrame, path: str) -> bool:
    return kind_of(df.schema, path) is not None


def column(df: DataFrame, path: str) -> Column:
    """The column of a path, named by the path; an index beyond an array's end is null."""
    if path in df.columns:
        return df[f"`{path}`"].alias(path)
    if not has_path(df, path):
        raise KeyError(f"column not found: {path}")
    first, *rest = steps(path)
    out, kind = F.col(f"`{first}`"), df.schema[first].dataType
    for step in rest:
        if isinstance(step, int):
            out, kind = F.get(out, F.lit(step)), kind.elementType
        elif isinstance(kind, MapType):
            out, kind = F.try_element_at(out, F.lit(step)), kind.valueType
        else:
            out, kind = out.getField(step), kind[step].dataType
    return out.alias(path)
