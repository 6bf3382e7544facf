"""Comparisons with two-valued logic: null equals null and sorts before everything, and no comparison is unknown.

The mode "core" follows that rule in full; in the mode "stream" a null value fails every ordering comparison.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType

from .paths import column, kind_of

#: Spellings of the operators.
ALIASES = {
    "=": "eq", "==": "eq", "eq": "eq", "!=": "ne", "<>": "ne", "ne": "ne", ">": "gt", "gt": "gt", ">=": "gte", "gte": "gte", "ge": "gte", "<": "lt", "lt": "lt", "<=": "lte", "lte": "lte", "le": "lte",
    "in": "in", "not in": "notIn", "notIn": "notIn", "not_in": "notIn", "between": "between", "like": "like", "is null": "isNull", "isNull": "isNull", "is not null": "isNotNull", "isNotNull": "isNotNull",
}
#: Operator names of the two filter dialects.
RANGE_DIALECT = {"$eq": "eq", "$lt": "lt", "$lte": "lte", "$gt": "gt", "$gte": "gte", "$ne": "ne", "$in": "in", "$nin": "notIn"}
SUFFIX_DIALECT = {"not": "ne", "gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte", "in": "in", "notIn": "notIn", "like": "like", "isNull": "isNull"}


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Any = None
    negate: bool = False

    @classmethod
    def of(cls, given: dict) -> Predicate:
        """From a mapping: column, operator, value or values or lowerBound and upperBound, not."""
        op = ALIASES.get(given.get("operator", given.get("op")))
        if op is None:
            raise ValueError(f"unknown operator: {given}")
        value = given.get("values", given.get("value"))
        if op == "between" and "lowerBound" in given:
            value = [given["lowerBound"], given["upperBound"]]
        return cls(given["column"], op, value, bool(given.get("not", False)))


def like_pattern(pattern: str) -> str:
    """A regular expression for % and _, whole string, any case; neither matches a line end."""
    parts = (".*" if c == "%" else "." if c == "_" else re.sub(r"([^A-Za-z0-9 ])", r"\\\1", c) for c in pattern)
    return r"(?i)\A" + "".join(parts) + r"\z"


def check_literal(path: str, kind: DataType, value: Any) -> None:
    """An error where a literal can never equal a value of the column's type: numbers are no text, and neither is a flag."""
    if value is None:
        return
    texts = isinstance(value, str)
    times = isinstance(value, (date, datetime))
    flags = isinstance(value, bool)
    numbers = isinstance(value, (int, float, Decimal)) and not flags
    fits = (
        texts if isinstance(kind, StringType) else numbers if isinstance(kind, NumericType) else flags if isinstance(kind, BooleanType)
        else times or texts if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else True
    )
    if not fits:
        raise TypeError(f"{path} is {kind.simpleString()} and cannot be compared with {value!r}")


def condition(c: Column, op: str, value: Any, mode: str = "core", nan: bool = False, text: bool = True) -> Column:
    """Whether the comparison holds: never null. Nulls are ruled out by IS NOT NULL, which scans understand.

    nan: the column has floating numbers; text: it has text, which like needs to hold.
    """
    yes, no = F.lit(True), F.lit(False)
    sure = lambda x: c.isNotNull() & x
    number = (lambda x: x & ~F.isnan(c)) if nan else (lambda x: x)
    if op == "eq":
        return c.eqNullSafe(value)
    if op == "ne":
        return ~c.eqNullSafe(value)
    if op in ("gt", "gte", "lt", "lte"):
        if value is None:
            return no if mode == "stream" else {"gt": c.isNotNull(), "gte": yes, "lt": no, "lte": c.isNull()}[op]
        holds = number({"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op])
        return sure(holds) if op in ("gt", "gte") or mode == "stream" else c.isNull() | holds
    if op == "between":
        if value is None or len(value) != 2:
            return no
        if any(v is None for v in value):
            return condition(c, "gte", value[0], mode, nan) & condition(c, "lte", value[1], mode, nan)
        return sure(number((c >= value[0]) & (c <= value[1])))
    if op in ("in", "notIn"):
        known = [v for v in value or [] if v is not None]
        holds = sure(c.isin(known)) if known else no
        if any(v is None for v in value or ()):
            holds = holds | c.isNull()
        return holds if op == "in" else ~holds
    if op == "like":
        return sure(c.rlike(like_pattern(value))) if isinstance(value, str) and text else no
    if op == "isNull":
        return c.isNull()
    if op == "isNotNull":
        return c.isNotNull()
    raise ValueError(f"unknown operator: {op}")


def predicate(df: DataFrame, p: Predicate, mode: str = "core") -> Column:
    """A comparison over a table's column, refused while planning where the literal's type can never match."""
    c, op = column(df, p.column), ALIASES[p.op]
    kind = kind_of(df.schema, p.column)
    if op not in ("like", "isNull", "isNotNull"):
        for value in p.value if isinstance(p.value, (list, tuple)) else [p.value]:
            check_literal(p.column, kind, value)
    value = p.value
    if isinstance(kind, TimestampNTZType) and op != "like":  # a literal of the column's own type reaches the scan
        one = lambda v: F.lit(v.isoformat() if isinstance(v, (date, datetime)) else v).cast("timestamp_ntz") if v is not None else None
        value = [one(v) for v in value] if isinstance(value, (list, tuple)) else one(value)
    holds = condition(c, op, value, mode, isinstance(kind, (DoubleType, FloatType)), isinstance(kind, StringType))
    return ~holds if p.negate else holds


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def equals(df: DataFrame, fields: dict[str, Any]) -> Column:
    """All fields equal; no fields match every row."""
    return all_of([predicate(df, Predicate(k, "eq", v)) for k, v in fields.items()])


def range_filter(df: DataFrame, given: dict[str, Any]) -> Column:
    """{field: value or {$lt, $lte, $gt, $gte, $ne, $in, ...}} in stream mode."""
    out = []
    for field, wanted in given.items():
        tests = wanted.items() if isinstance(wanted, dict) else [("$eq", wanted)]
        out += [predicate(df, Predicate(field, RANGE_DIALECT[op], v), "stream") for op, v in tests]
    return all_of(out)


def tree_filter(df: DataFrame, given: dict[str, Any]) -> Column:
    """{field: v, field_gt: v, AND: [...], OR: [...], NOT: {...}} as a boolean tree."""
    out = []
    for key, value in given.items():
        if key in ("AND", "OR"):
            parts = [tree_filter(df, x) for x in value]
            out.append(all_of(parts) if key == "AND" else any_of(parts))
        elif key == "NOT":
            out.append(~tree_filter(df, value))
        elif key in df.columns:
            out.append(predicate(df, Predicate(key, "eq", value)))
        else:
            field, _, suffix = key.rpartition("_")
            if suffix not in SUFFIX_DIALECT:
                raise ValueError(f"unknown filter: {key}")
            op = SUFFIX_DIALECT[suffix]
            out.append(predicate(df, Predicate(field, op, value, negate=op == "isNull" and value is False)))
    return all_of(out)
