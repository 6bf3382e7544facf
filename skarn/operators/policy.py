"""Row policies: a row may be seen if any select policy allows it; a change must satisfy all policies of its kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_of, any_of

#: What policies are for; one for "all" counts for each.
OPERATIONS = ("select", "insert", "update", "delete")


@dataclass
class Policies:
    """Policies by table and operation: functions from the user's context to a condition. Without any, everything is allowed."""

    rules: dict[tuple[str, str], list[Callable[[dict], Column]]] = field(default_factory=dict)

    def add(self, table: str, operation: str, rule: Callable[[dict], Column]) -> None:
        if operation not in (*OPERATIONS, "all"):
            raise ValueError(f"unknown operation: {operation}")
        for op in OPERATIONS if operation == "all" else (operation,):
            self.rules.setdefault((table, op), []).append(rule)

    def guards(self, table: str, operation: str) -> bool:
        return bool(self.rules.get((table, operation)))

    def condition(self, table: str, operation: str, context: dict) -> Column:
        found = self.rules.get((table, operation), [])
        if not found or context.get("bypass"):
            return F.lit(True)
        tests = [F.coalesce(rule(context), F.lit(False)) for rule in found]
        return any_of(tests) if operation == "select" else all_of(tests)

    def visible(self, table: str, df: DataFrame, context: dict) -> DataFrame:
        return df.where(self.condition(table, "select", context))

    def check(self, table: str, operation: str, df: DataFrame, context: dict) -> DataFrame:
        """df itself if its rows may all be changed so; else an error."""
        if self.guards(table, operation) and not df.where(~self.condition(table, operation, context)).isEmpty():
            raise PermissionError(f"a policy of {table} forbids this {operation}")
        return df
