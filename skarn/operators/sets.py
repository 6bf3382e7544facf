"""Set operators, joins that the data model implies, and ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType

INTEGERS = (ShortType, IntegerType)


def promoted(a: DataType, b: DataType) -> DataType:
    """The type that holds both: null gives way, integers widen, integer and fraction give fraction, all else is text."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    kinds = (a, b)
    if all(isinstance(k, (*INTEGERS, LongType)) for k in kinds):
        return LongType()
    if all(isinstance(k, (*INTEGERS, FloatType, DoubleType)) for k in kinds):
        return DoubleType()
    return StringType()


def append_evolved(*frames: DataFrame) -> DataFrame:
    """All rows of frames with different columns: missing ones are null, differing types promoted."""
    kinds: dict[str, DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = promoted(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    aligned = [df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]) for df in frames]
    return reduce(DataFrame.unionByName, aligned)


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the ascending order of some columns, nulls first.

    The least row is taken in tasks before the shuffle, so a hot key is one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__first")
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first)
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col("__first").getField(c).alias(c) for c in rest]).select(*[f"`{c}`" for c in df.columns])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k rows before it shuffles them."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def merged_in_order(frames: list[DataFrame], order: list[Column]) -> DataFrame:
    """All rows of sorted tables in one order: one range shuffle, in which rows that stand in order are merged."""
    return reduce(DataFrame.unionByName, frames).orderBy(*order)


def embedded(df: DataFrame, array: str, holds: Callable[[Column], Column], take: Callable[[Column], Column], name: str) -> DataFrame:
    """df with what `take` makes of the elements of an array for which `holds` does; nothing is exploded."""
    return df.withColumn(name, F.transform(F.filter(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType)), holds), take))


def exploded_statistics(df: DataFrame, array: str, value: str, name: str = "element") -> DataFrame:
    """For each distinct element of an array column: rows that hold it, and mean, least and greatest of a value."""
    rows = df.select(F.explode(F.array_distinct(F.col(array))).alias(name), F.col(value).alias("__value"))
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.avg("__value").alias("mean"), F.min("__value").alias("low"), F.max("__value").alias("high"))


def rollup_with_top(df: DataFrame, keys: list[str], value: str, order: list[Column], key: str, k: int) -> DataFrame:
    """For each group: rows, mean of a value, and the keys of its first k rows in order. Groups are cut to k rows in the tasks first."""
    about = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    top = top_per_group(df.select(*keys, *{c for c in df.columns if c not in keys}), keys, order, k)
    listed = top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("top"))
    return about.join(listed, keys)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    return {"removed": a.join(b, keys, "left_anti"), "added": b.join(a, keys, "left_anti"), "unchanged": a.join(b, keys, "left_semi")}


def denormalised(parent: DataFrame, child: DataFrame, on: str, parent_key: str, name: str, fields: list[str]) -> DataFrame:
    """Each parent with its children as an ordered array of structs (empty without children)."""
    children = child.groupBy(F.col(on).alias(parent_key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(children, parent_key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(children.schema[name].dataType)))


def page_through(df: DataFrame, order: list[Column], size: int):
    """Rows in pages, each a list, without collecting them at once."""
    out = []
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def take_while(df: DataFrame, holds: Column, order: list[Column], skip: bool = False) -> DataFrame:
    """The rows up to the first that fails, in the given order; with skip, the rows from that one on.

    The first failing row is found by an aggregate, so no task gets all rows.
    """
    key = F.struct(*order)
    first = df.where(~F.coalesce(holds, F.lit(False))).agg(F.min(key).alias("k")).first()["k"]
    if first is None:
        return df.limit(0) if skip else df
    kinds = df.select(*order).schema
    limit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(first, kinds, strict=True)])
    return df.where(key >= limit) if skip else df.where(key < limit)
