"""Steps over the rows of a table, each lazy until a result is asked for; order-dependent ones name their order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .sets import page_through, take_while


class Rows:
    """A table with the steps of a stream of rows."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, holds: Column) -> Rows:
        return Rows(self.df.where(holds))

    def map(self, **columns: Column) -> Rows:
        return Rows(self.df.select(*[c.alias(name) for name, c in columns.items()]))

    def flat_map(self, array: Column, name: str) -> Rows:
        """A row for each element of an array."""
        return Rows(self.df.select(F.explode(array).alias(name)))

    def take(self, n: int) -> Rows:
        return Rows(self.df.limit(n))

    def skip(self, n: int) -> Rows:
        return Rows(self.df.offset(n))

    def take_while(self, holds: Column, order: list[Column]) -> Rows:
        return Rows(take_while(self.df, holds, order))

    def skip_while(self, holds: Column, order: list[Column]) -> Rows:
        return Rows(take_while(self.df, holds, order, skip=True))

    def concat(self, *others: Rows) -> Rows:
        out = self.df
        for other in others:
            out = out.unionByName(other.df)
        return Rows(out)

    def distinct(self, *keys: str) -> Rows:
        return Rows(self.df.dropDuplicates(list(keys)) if keys else self.df.distinct())

    def tap(self, look: Callable[[DataFrame], None]) -> Rows:
        """Lets look see the table on the way."""
        look(self.df)
        return self

    def batches(self, order: list[Column], size: int) -> Iterator[list[Row]]:
        return page_through(self.df, order, size)

    def reduce(self, **aggregates: Column) -> Row:
        return self.df.agg(*[c.alias(name) for name, c in aggregates.items()]).first()

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[Row]:
        return self.df.collect()

    def first(self) -> Row | None:
        return self.df.first()

    def find(self, holds: Column) -> Row | None:
        return self.df.where(holds).first()

    def some(self, holds: Column) -> bool:
        return not self.df.where(holds).isEmpty()

    def every(self, holds: Column) -> bool:
        """Whether it holds for all rows; a null does not."""
        return self.df.where(~F.coalesce(holds, F.lit(False))).isEmpty()
