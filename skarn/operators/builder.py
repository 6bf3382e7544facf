"""A fluent builder over QuerySpec, and an engine that finds tables by name, guards them by policies and keeps results."""

from __future__ import annotations

import fnmatch
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate
from ..functions.expressions import Expression
from ..functions.predicates import ALIASES, Predicate
from ..plans import compile as plan
from ..plans.spec import QuerySpec, SortKey
from ..sources import files
from .lakehouse import Table, pruned
from .policy import Policies
from .sets import denormalised


class Query:
    """Collects a QuerySpec; every method returns a new Query."""

    def __init__(self, engine: Engine, spec: QuerySpec):
        self.engine, self.spec = engine, spec

    def _with(self, **changes) -> Query:
        return Query(self.engine, replace(self.spec, **changes))

    # rows
    def where(self, column: str, op: str, value: Any = None) -> Query:
        return self._with(where=(*self.spec.where, Predicate(column, ALIASES[op], value)))

    def where_not(self, column: str, op: str, value: Any = None) -> Query:
        return self._with(where=(*self.spec.where, Predicate(column, ALIASES[op], value, True)))

    def where_in(self, column: str, values: list) -> Query:
        return self.where(column, "in", values)

    def where_not_in(self, column: str, values: list) -> Query:
        return self.where(column, "notIn", values)

    def where_between(self, column: str, low: Any, high: Any) -> Query:
        return self.where(column, "between", [low, high])

    def where_like(self, column: str, pattern: str) -> Query:
        return self.where(column, "like", pattern)

    def where_null(self, column: str) -> Query:
        return self.where(column, "isNull")

    def where_not_null(self, column: str) -> Query:
        return self.where(column, "isNotNull")

    def compute(self, **made: Expression) -> Query:
        """Columns made before filters; each may use those before it."""
        return self._with(compute=(*self.spec.compute, *made.items()))

    # columns
    def select(self, *columns: str) -> Query:
        return self._with(columns=tuple(columns))

    def rename(self, **aliases: str) -> Query:
        return self._with(aliases=tuple((k, v) for k, v in aliases.items()))

    def with_metadata(self) -> Query:
        return self._with(metadata=True)

    def missing_as_null(self) -> Query:
        return self._with(missing="null")

    def finish(self, **made: Expression) -> Query:
        """Columns made of the groups, or of the rows that are left."""
        return self._with(finish=(*self.spec.finish, *made.items()))

    # groups
    def group_by(self, *columns: str) -> Query:
        return self._with(group_by=tuple(columns))

    def aggregate(self, fn: str, column: str | None = None, alias: str | None = None, **how) -> Query:
        return self._with(aggregates=(*self.spec.aggregates, Aggregate(fn, column, alias, **how)))

    def count(self, alias: str = "count") -> Query:
        return self.aggregate("count", None, alias)

    def count_distinct(self, column: str, alias: str | None = None) -> Query:
        return self.aggregate("countDistinct", column, alias)

    def sum(self, column: str, alias: str | None = None) -> Query:
        return self.aggregate("sum", column, alias)

    def avg(self, column: str, alias: str | None = None) -> Query:
        return self.aggregate("avg", column, alias)

    def min(self, column: str, alias: str | None = None) -> Query:
        return self.aggregate("min", column, alias)

    def max(self, column: str, alias: str | None = None) -> Query:
        return self.aggregate("max", column, alias)

    def having(self, alias: str, op: str, value: Any) -> Query:
        return self._with(having=(*self.spec.having, Predicate(alias, ALIASES[op], value)))

    # order and pages
    def order_by(self, column: str, direction: str = "asc", nulls: str | None = None) -> Query:
        return self._with(order_by=(*self.spec.order_by, SortKey(column, direction == "desc", nulls)))

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def page(self, number: int, size: int) -> Query:
        return self._with(limit=size, offset=(number - 1) * size)

    # planning
    def as_of_snapshot(self, id: int) -> Query:
        return self._with(as_of=("id", id))

    def as_of(self, at: float) -> Query:
        """The table as it was at a time (seconds since 1970)."""
        return self._with(as_of=("at", at))

    def hint(self, name: str, *arguments: Any) -> Query:
        return self._with(hints=(*self.spec.hints, (name, arguments)))

    def timeout(self, seconds: float) -> Query:
        return self._with(timeout=seconds)

    # results
    def to_df(self) -> DataFrame:
        return self.engine.run(self.spec)

    def collect(self) -> list[Row]:
        """The rows; a query with a timeout is interrupted when it is over."""
        df = self.to_df()
        if self.spec.timeout is None:
            return df.collect()
        context, tag, late = df.sparkSession.sparkContext, f"skarn-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.spec.timeout, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"the query took more than {self.spec.timeout} seconds") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def first(self) -> Row | None:
        return next(iter(self.limit(1).collect()), None)

    def exists(self) -> bool:
        return not self.to_df().isEmpty()

    def explain(self) -> str:
        """The formatted physical plan."""
        df = self.to_df()
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    def plan(self) -> dict:
        """What the query will read and do: files kept and pruned of a versioned table, steps, and the planner's estimate in bytes."""
        table, steps = self.engine.tables.get(self.spec.table), []
        s = self.spec
        for name, there in (("filter", s.where), ("aggregate", s.aggregates or s.group_by), ("having", s.having), ("sort", s.order_by), ("limit", s.limit is not None or s.offset), ("project", s.columns)):
            steps += [name] if there else []
        out = {"table": s.table, "steps": steps, "estimated_bytes": int(str(self.to_df()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))}
        if isinstance(table, Table):
            snapshot = self.engine.snapshot(s)
            kept = pruned(snapshot, pruning_tests(s))
            out |= {"snapshot": snapshot.id, "files": len(snapshot.files), "files_read": len(kept), "bytes_read": sum(f.size for f in kept)}
        return out


def pruning_tests(spec: QuerySpec) -> list[tuple]:
    """The predicates over stored columns, as files' bounds are tested."""
    made = {name for name, _ in spec.compute}
    return [(p.column, p.op, p.value) for p in spec.where if not p.negate and p.column not in made and "." not in p.column]


@dataclass(frozen=True)
class Relation:
    """Rows of `many` point at one row of `one`."""

    name: str
    many: str
    key: str
    one: str
    one_key: str


class Engine:
    """Tables by name: Parquet below a folder, given DataFrames, versioned tables, files of other formats.

    With policies, a guarded table is only read or changed for a user's context (as_user()), and only the rows that the context allows.
    """

    def __init__(self, spark, folder: str | None = None, policies: Policies | None = None):
        self.spark, self.folder, self.policies = spark, folder, policies or Policies()
        self.tables: dict[str, DataFrame | Table] = {}
        self.relations: dict[str, Relation] = {}
        self.context: dict | None = None

    def as_user(self, context: dict) -> Engine:
        """The same tables and policies for a user."""
        other = Engine(self.spark, self.folder, self.policies)
        other.tables, other.relations, other.context = self.tables, self.relations, context
        return other

    # tables
    def register(self, name: str, table: DataFrame | Table) -> None:
        self.tables[name] = table

    def attach(self, name: str, kind: str, path: str, **options) -> None:
        """A table in files of a registered format (see sources.files.READERS)."""
        self.tables[name] = files.READERS[kind](self.spark, path, **options)

    def snapshot(self, spec: QuerySpec):
        table = self.tables[spec.table]
        if spec.as_of is None:
            return table.current()
        kind, value = spec.as_of
        return table.as_of(**{kind: value})

    def scan(self, name: str) -> DataFrame:
        """A table's rows, whatever policies say: for the engine's own use."""
        table = self.tables.get(name)
        if isinstance(table, Table):
            return table.read()
        if table is not None:
            return table
        if self.folder is None:
            raise KeyError(f"unknown table: {name}")
        return files.read_table(self.spark, self.folder, name)

    def metadata(self, name: str) -> dict:
        """Columns of a table, and where they are kept files, rows and bytes, without reading rows."""
        table = self.tables.get(name)
        if isinstance(table, Table):
            snapshot = table.current()
            return {"columns": {f.name: f.dataType.simpleString() for f in snapshot.struct}, "partition_by": snapshot.partition_by, **table.totals(snapshot)}
        df = self.scan(name)
        return {"columns": dict(df.dtypes), "files": len(df.inputFiles())}

    def table(self, name: str) -> Query:
        return Query(self, QuerySpec(name))

    # reading
    def _allowed(self, name: str, df: DataFrame, operation: str = "select") -> DataFrame:
        if not self.policies.guards(name, operation):
            return df
        if self.context is None:
            raise PermissionError(f"{name} has row policies: ask as a user")
        return self.policies.visible(name, df, self.context) if operation == "select" else self.policies.check(name, operation, df, self.context)

    def run(self, spec: QuerySpec | dict) -> DataFrame:
        spec = QuerySpec.of(spec) if isinstance(spec, dict) else spec
        table = self.tables.get(spec.table)
        if isinstance(table, Table):
            rows = table.read(self.snapshot(spec), pruning_tests(spec))
        elif spec.as_of is not None:
            raise ValueError(f"{spec.table} has no versions")
        else:
            rows = self.scan(spec.table)
        return plan.run(spec, self._allowed(spec.table, rows))

    # relations
    def relate(self, name: str, many: str, key: str, one: str, one_key: str) -> None:
        """Declares that rows of many point at rows of one."""
        self.relations[name] = Relation(name, many, key, one, one_key)

    def related(self, name: str, embed: Iterable[str] | None = None) -> DataFrame:
        """Each row of many with its row of one; with embed (columns of many), each row of one with its rows of many as an array."""
        r = self.relations[name]
        many, one = self._allowed(r.many, self.scan(r.many)), self._allowed(r.one, self.scan(r.one))
        if embed is not None:
            return denormalised(one, many, r.key, r.one_key, name, list(embed))
        right = one.select(F.col(f"`{r.one_key}`").alias("__one"), F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias(name))
        return many.join(right, many[f"`{r.key}`"] == right["__one"], "left").drop("__one")

    # writing
    def _versioned(self, name: str) -> Table:
        table = self.tables.get(name)
        if not isinstance(table, Table):
            raise ValueError(f"{name} is no versioned table")
        return table

    def insert(self, name: str, rows: DataFrame):
        """Appends documents to a versioned table; every row must be allowed."""
        return self._versioned(name).insert(self._allowed(name, rows, "insert"))

    def update(self, name: str, where: Column, values: dict):
        """Changes the rows that the user sees and where holds; all of them must be allowed to be changed."""
        test = self._changing(name, where, "update")
        return self._versioned(name).update(test, values)

    def delete(self, name: str, where: Column):
        return self._versioned(name).delete(self._changing(name, where, "delete"))

    def _changing(self, name: str, where: Column, operation: str) -> Column:
        test = F.coalesce(where, F.lit(False))
        if self.policies.guards(name, "select"):
            if self.context is None:
                raise PermissionError(f"{name} has row policies: ask as a user")
            test = test & self.policies.condition(name, "select", self.context)
        self._allowed(name, self._versioned(name).read().where(test), operation)
        return test


class QueryCache:
    """Results of an engine's queries by their spec, user and the table's version, for some seconds and up to some entries.

    Results are kept by Spark (memory and disk of executors, made anew if one is lost) and let go when their entry goes.
    """

    def __init__(self, engine: Engine, seconds: float = 60.0, most: int = 100):
        self.engine, self.seconds, self.most = engine, seconds, most
        self.held: OrderedDict[tuple, tuple[float, str, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    def _key(self, spec: QuerySpec) -> tuple:
        table = self.engine.tables.get(spec.table)
        version = self.engine.snapshot(spec).id if isinstance(table, Table) else id(table) if table is not None else self.engine.folder
        return repr(spec), repr(sorted((self.engine.context or {}).items(), key=str)), version

    def run(self, spec: QuerySpec | dict) -> DataFrame:
        spec = QuerySpec.of(spec) if isinstance(spec, dict) else spec
        key, now = self._key(spec), time.monotonic()
        for old in [k for k, (until, _, _) in self.held.items() if until <= now]:
            self._drop(old)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][2]
        self.misses += 1
        df = self.engine.run(spec).persist()
        self.held[key] = (now + self.seconds, spec.table, df)
        while len(self.held) > self.most:
            self._drop(next(iter(self.held)))
        return df

    def _drop(self, key: tuple) -> None:
        self.held.pop(key)[2].unpersist()

    def invalidate(self, pattern: str = "*") -> int:
        """Lets go the results of the tables whose name fits a pattern; returns how many."""
        gone = [k for k, (_, table, _) in self.held.items() if fnmatch.fnmatchcase(table, pattern)]
        for key in gone:
            self._drop(key)
        return len(gone)
