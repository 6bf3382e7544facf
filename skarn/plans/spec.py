"""The one query description: what to read, keep, group, order and return. Everything else is Catalyst's."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..functions.aggregates import Aggregate
from ..functions.expressions import Expression
from ..functions.predicates import Predicate


@dataclass(frozen=True)
class SortKey:
    """nulls: None follows the direction (last when ascending, first when descending)."""

    column: str
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class QuerySpec:
    """compute: columns made before anything else, finish: columns made of the grouped or filtered rows; each may use those before it.

    hints: names and arguments for the planner; as_of: id or time of a versioned table's snapshot.
    """

    table: str
    where: tuple[Predicate, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    having: tuple[Predicate, ...] = ()
    order_by: tuple[SortKey, ...] = ()
    columns: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int = 0
    metadata: bool = False
    missing: str = "error"
    compute: tuple[tuple[str, Expression], ...] = ()
    finish: tuple[tuple[str, Expression], ...] = ()
    hints: tuple[tuple[str, tuple], ...] = ()
    as_of: tuple[str, Any] | None = None
    timeout: float | None = None

    @classmethod
    def of(cls, given: dict) -> QuerySpec:
        """From a mapping: table, predicates, groupBy, aggregations, orderBy, projection, limit, offset, compute, finish, snapshotId, asOf.

        A predicate on an aggregate's alias restricts groups, not rows.
        """
        aggregates = tuple(Aggregate.of(a) for a in given.get("aggregations") or ())
        predicates = [Predicate.of(p) for p in given.get("predicates") or ()]
        names = {a.name for a in aggregates}
        order = tuple(SortKey(o["column"], str(o.get("direction", "asc")).lower() == "desc", o.get("nulls")) for o in given.get("orderBy") or ())
        projection = given.get("projection") or {}
        projection = projection if isinstance(projection, dict) else {"columns": projection}
        return cls(
            given["table"], tuple(p for p in predicates if p.column not in names), tuple(given.get("groupBy") or ()), aggregates, tuple(p for p in predicates if p.column in names), order,
            tuple(projection.get("columns") or ()), tuple((projection.get("aliases") or {}).items()), given.get("limit"), int(given.get("offset") or 0), bool(projection.get("includeMetadata")), given.get("missing", "error"),
            tuple((given.get("compute") or {}).items()), tuple((given.get("finish") or {}).items()), tuple((n, tuple(a)) for n, a in (given.get("hints") or {}).items()),
            ("id", given["snapshotId"]) if given.get("snapshotId") is not None else ("at", given["asOf"]) if given.get("asOf") is not None else None, given.get("timeout"),
        )
