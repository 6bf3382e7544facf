"""Scalar expressions of queries: paths, literals, functions and cases, as plain data.

An expression is a path ("a.b"), {"lit": value}, {"fn": name, "args": [expressions]} or
{"case": [[predicates, expression], ...], "else": expression}. Arguments that a function takes as plain values (patterns, places,
units) are literals.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import column
from .predicates import Predicate, all_of, predicate
from .scalar import rounded

Expression = str | dict[str, Any]


def _whole(c: Column) -> Column:
    return c.cast("long")


#: Functions of columns.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "mod": lambda a, b: a % b,
    "floor": F.floor,
    "abs": F.abs,
    "log10": F.log10,
    "sqrt": F.sqrt,
    "length": F.length,
    "lower": F.lower,
    "upper": F.upper,
    "concat": F.concat,
    "coalesce": F.coalesce,
    "size": F.size,
    "contains": lambda a, b: a.contains(b),
    "starts_with": lambda a, b: a.startswith(b),
    "array_contains": lambda a, b: F.array_contains(a, b),
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "integer": lambda a: a.cast("int"),
    "whole": _whole,
    "number": lambda a: a.cast("double"),
    "text": lambda a: a.cast("string"),
}
#: Functions with plain values behind the first column.
WITH_VALUES: dict[str, Callable[..., Column]] = {
    "round": lambda c, places=0: F.round(c, places),
    "half_up": lambda c, places=2: rounded(c, places),
    "replace": lambda c, pattern, by: F.regexp_replace(c, pattern, by),
    "extract": lambda c, pattern, group=0: F.regexp_extract(c, pattern, group),
    "substring": lambda c, start, n: F.substring(c, start, n),
    "truncate_time": lambda c, unit: F.date_trunc(unit, c).cast("timestamp_ntz"),
    "prefix": lambda c, n: F.substring(c, 1, n),
}


def register(name: str, function: Callable[..., Column]) -> None:
    """Adds a function of columns to the expressions of all queries."""
    if name in FUNCTIONS or name in WITH_VALUES:
        raise ValueError(f"function {name} exists")
    FUNCTIONS[name] = function


def lit(value: Any) -> dict[str, Any]:
    return {"lit": value}


def fn(name: str, *args: Any) -> dict[str, Any]:
    return {"fn": name, "args": list(args)}


def case(*whens: tuple[list[dict], Expression], otherwise: Expression | None = None) -> dict[str, Any]:
    return {"case": [list(w) for w in whens], "else": otherwise}


def used(e: Expression) -> set[str]:
    """The columns that an expression starts from."""
    if isinstance(e, str):
        return {e, e.split(".")[0].split("[")[0]}
    if "case" in e:
        tests = {t.column if isinstance(t, Predicate) else t["column"] for when in e["case"] for t in when[0]}
        return tests.union(*(used(when[1]) for when in e["case"]), used(e["else"]) if e.get("else") is not None else set())
    return set().union(*(used(a) for a in e.get("args", []) if isinstance(a, (str, dict))))


def expression(df: DataFrame, e: Expression) -> Column:
    """The Column of an expression over a table."""
    if isinstance(e, str):
        return column(df, e)
    if "lit" in e:
        return F.lit(e["lit"])
    if "case" in e:
        out = None
        for tests, value in e["case"]:
            test = all_of([predicate(df, t if isinstance(t, Predicate) else Predicate.of(t)) for t in tests])
            out = F.when(test, expression(df, value)) if out is None else out.when(test, expression(df, value))
        return out if e.get("else") is None else out.otherwise(expression(df, e["else"]))
    name, args = e["fn"], e.get("args", [])
    if name in WITH_VALUES:
        return WITH_VALUES[name](expression(df, args[0]), *[a["lit"] if isinstance(a, dict) and "lit" in a else a for a in args[1:]])
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function: {name}")
    return FUNCTIONS[name](*[expression(df, a) for a in args])
