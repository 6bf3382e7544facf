"""Chains of steps over DataFrames: sequence, branches, conditions, pipelines with rejects, map and reduce."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Chain:
    """Named steps with the names of the steps they need; runs in an order that respects the needs.

    A need that is no step is an input, given to run() by name.
    """

    steps: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], Callable[[], bool] | None]] = field(default_factory=dict)

    def step(self, name: str, run: Callable[..., DataFrame], needs: tuple[str, ...] = (), when: Callable[[], bool] | None = None) -> Chain:
        if name in self.steps:
            raise ValueError(f"step {name} exists")
        self.steps[name] = (run, needs, when)
        return self

    def order(self, inputs: Iterable[str] = ()) -> list[str]:
        out: list[str] = []
        state: dict[str, int] = dict.fromkeys(inputs, 2)

        def visit(name: str) -> None:
            if name not in self.steps and name not in state:
                raise ValueError(f"unknown step: {name}")
            if state.get(name) == 1:
                raise ValueError(f"steps need each other: {name}")
            if name not in state:
                state[name] = 1
                for need in self.steps[name][1]:
                    visit(need)
                state[name] = 2
                out.append(name)

        for name in self.steps:
            visit(name)
        return out

    def levels(self, inputs: Iterable[str] = ()) -> list[list[str]]:
        """The steps that can run side by side, level by level."""
        level: dict[str, int] = {}
        for name in self.order(inputs):
            level[name] = 1 + max((level.get(n, -1) for n in self.steps[name][1]), default=-1)
        return [[n for n, k in level.items() if k == depth] for depth in range(max(level.values(), default=-1) + 1)]

    def run(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        """The DataFrame of each step (lazy); a step whose condition fails passes its first need on."""
        done: dict[str, DataFrame] = dict(inputs)
        for name in self.order(inputs):
            run, needs, when = self.steps[name]
            inputs = [done[n] for n in needs]
            done[name] = inputs[0] if when is not None and not when() and inputs else run(*inputs)
        return done


def partitioned(df: DataFrame, n: int, by: str | None = None, ordered: bool = False) -> DataFrame:
    """df dealt into n parts: evenly, by a key's hash, or by a key's ranges."""
    if by is None:
        return df.repartition(n)
    return df.repartitionByRange(n, by) if ordered else df.repartition(n, by)


def word_count(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pipeline(df: DataFrame, transform: list[Step], valid: Column | None = None, enrich: list[Step] = ()) -> tuple[DataFrame, DataFrame | None]:
    """Transformed, validated and enriched rows, and the rejected ones."""
    for step in transform:
        df = df.transform(step)
    rejected = df.where(~F.coalesce(valid, F.lit(False))) if valid is not None else None
    df = df.where(valid) if valid is not None else df
    for step in enrich:
        df = df.transform(step)
    return df, rejected
