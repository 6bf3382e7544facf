"""QuerySpec and DataFrame to DataFrame: filter, aggregate, having, sort, page, project. Lazy throughout."""

from __future__ import annotations

import base64
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import summed
from ..functions.expressions import Expression, expression, used
from ..functions.paths import column, has_path
from ..functions.predicates import all_of, predicate
from .spec import QuerySpec, SortKey

METADATA = ("_id", "_version")


def ordering(c: Column, key: SortKey) -> Column:
    first = key.descending if key.nulls is None else key.nulls == "first"
    if key.descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def filtered(df: DataFrame, spec: QuerySpec, mode: str = "core") -> DataFrame:
    return df.where(all_of([predicate(df, p, mode) for p in spec.where])) if spec.where else df


def paged(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """The rows from offset on, at most limit (0: none)."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def projected(df: DataFrame, spec: QuerySpec) -> DataFrame:
    if not spec.columns:
        return df if spec.metadata else df.drop(*[c for c in df.columns if c.startswith("_")])
    aliases, out = dict(spec.aliases), []
    for path in (*spec.columns, *(c for c in METADATA if spec.metadata and c in df.columns and c not in spec.columns)):
        if has_path(df, path):
            out.append(column(df, path).alias(aliases.get(path, path)))
        elif spec.missing == "null":
            out.append(F.lit(None).cast("string").alias(aliases.get(path, path)))
        elif spec.missing == "error":
            raise KeyError(f"column not found: {path}")
    return df.select(*out)


def computed(df: DataFrame, made: tuple[tuple[str, Expression], ...]) -> DataFrame:
    """df with columns that may use those made before them; what needs nothing new is made in one step."""
    step: dict[str, Column] = {}
    for name, e in made:
        if name in step or used(e) & step.keys():
            df, step = df.withColumns(step), {}
        step[name] = expression(df, e)
    return df.withColumns(step) if step else df


def run(spec: QuerySpec, df: DataFrame, mode: str = "core") -> DataFrame:
    """The query's result; sort keys may be columns that the projection drops."""
    for name, arguments in spec.hints:
        df = df.hint(name, *arguments)
    df = filtered(computed(df, spec.compute), spec, mode)
    if spec.aggregates or spec.group_by:
        keys = [column(df, k) for k in spec.group_by]
        df = summed(df, keys, spec.aggregates) if spec.aggregates else df.select(*keys).distinct()
        if spec.having:
            df = df.where(all_of([predicate(df, p, mode) for p in spec.having]))
    df = computed(df, spec.finish)
    if spec.order_by:
        df = df.orderBy(*[ordering(column(df, k.column), k) for k in spec.order_by])
    return projected(paged(df, spec.limit, spec.offset), spec)


def page(spec: QuerySpec, df: DataFrame) -> tuple[DataFrame, bool]:
    """A page and whether more rows follow, found by looking one row ahead; the page's rows are read once."""
    if spec.limit is None:
        return run(spec, df), False
    rows = run(replace(spec, limit=spec.limit + 1), df)
    held = rows.collect()  # a page
    return df.sparkSession.createDataFrame(held[: spec.limit], rows.schema), len(held) > spec.limit


def cursor(offset: int) -> str:
    """The token of a row's place in an ordered result."""
    return base64.urlsafe_b64encode(f"row:{offset}".encode()).decode()


def place(token: str) -> int:
    kind, _, number = base64.urlsafe_b64decode(token.encode()).decode().partition(":")
    if kind != "row" or not number.isdigit():
        raise ValueError(f"not a cursor: {token}")
    return int(number)


def connection(spec: QuerySpec, df: DataFrame, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None) -> tuple[DataFrame, dict]:
    """The first rows after a cursor, or the last ones before one, and whether pages lie before and behind, with the cursors of both ends."""
    if not spec.order_by:
        raise ValueError("paging by cursor needs an order")
    if (first is None) == (last is None):
        raise ValueError("either first or last")
    start = place(after) + 1 if after else 0
    if last is not None:
        end = place(before) if before else run(replace(spec, limit=None, offset=0), df).count()
        start, first = max(start, end - last), min(last, max(end - start, 0))
    elif before:
        first = min(first, max(place(before) - start, 0))
    rows, more = page(replace(spec, limit=first, offset=start), df)
    n = rows.count()
    ends = {"startCursor": cursor(start), "endCursor": cursor(start + n - 1)} if n else {"startCursor": None, "endCursor": None}
    return rows, {"hasNextPage": more, "hasPreviousPage": start > 0, **ends}
