"""Scalar functions: partition transforms, coercion, bands, vector arithmetic. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = 1 << 32


def date_part(c: Column, part: str) -> Column:
    """year, month, day or hour (UTC)."""
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}[part](c)


def string_hash(c: Column) -> Column:
    """The 32-bit hash h = 31 h + unit over the UTF-16 units of a string, signed."""
    coded = F.hex(F.encode(c.cast("string"), "UTF-16BE"))
    places = F.when(F.length(coded) > 0, F.sequence(F.lit(0), (F.length(coded) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    units = F.transform(places, lambda i: F.conv(F.substring(coded, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    wrapped = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: F.pmod(h * 31 + u, F.lit(WRAP)))
    return F.when(wrapped >= WRAP // 2, wrapped - WRAP).otherwise(wrapped)


def bucket(c: Column, n: int) -> Column:
    return (F.abs(string_hash(c)) % n).cast("int")


def truncate(c: Column, width: int, text: bool = False) -> Column:
    """The largest multiple of width not above a number, or a string's first width characters."""
    return F.substring(c, 1, width) if text else F.floor(c / width) * width


def partition_values(transforms: list[tuple[str, Column, int | None]]) -> list[Column]:
    """(name, column, argument) with transforms named by the start of the name: year, month, day, hour, bucket, truncate, identity."""
    out = []
    for name, c, argument in transforms:
        kind = name.split("_")[0]
        value = date_part(c, kind) if kind in ("year", "month", "day", "hour") else bucket(c, argument) if kind == "bucket" else truncate(c, argument) if kind == "truncate" else c.cast("string")
        out.append(value.alias(name))
    return out


def partition_path(names: list[str]) -> Column:
    """name=value/name=value of a row's partition columns; null is __HIVE_DEFAULT_PARTITION__."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for n in names])


def parsed_partition_path(path: Column) -> Column:
    """A map of the partition columns of a path; the default partition's value is null, other parts of the path are left out."""
    parts = F.filter(F.split(path, "/"), lambda x: x.contains("="))
    value = lambda x: F.substring(x, F.instr(x, "=") + 1, F.length(x))
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.nullif(F.url_decode(value(x)), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("v"))
    return F.map_from_entries(F.transform(parts, pair))


def shard(c: Column, n: int) -> Column:
    """A value's shard: the 32-bit hash that Spark deals rows by, so that repartition(n, c) puts the shard's rows together."""
    return F.pmod(F.hash(c), F.lit(n))


def coerce(c: Column, kind: str) -> Column:
    """A string as another type by its longest numeric beginning; null where there is none."""
    s = F.trim(c.cast("string"))
    if kind in ("int", "long"):
        return F.regexp_extract(s, r"^[+-]?[0-9]+", 0).try_cast(kind)
    if kind == "double":
        return F.regexp_extract(s, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double")
    if kind == "boolean":
        return s.isin("true", "1")
    return s if kind == "string" else s.try_cast(kind)


def banded(c: Column, bands: list[tuple[float, str]], above: str) -> Column:
    """The name of the first band whose upper limit exceeds the value."""
    out = None
    for limit, name in bands:
        out = F.when(c < limit, name) if out is None else out.when(c < limit, name)
    return out.otherwise(above)


def rounded(c: Column, places: int = 2) -> Column:
    return F.floor(c * 10**places + 0.5) / 10**places


def _pairs(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column, metric: str) -> Column:
    """l2sq, l2, cosine (1 where a norm is 0), dot (negative product), manhattan, over the common length."""
    if metric in ("l2", "l2sq"):
        squared = _pairs(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.sqrt(squared) if metric == "l2" else squared
    if metric == "manhattan":
        return _pairs(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "dot":
        return -dot(a, b)
    if metric == "cosine":
        size = norm(a) * norm(b)
        return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)
    raise ValueError(f"unknown metric: {metric}")


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def score(d: Column, metric: str) -> Column:
    """A similarity of a distance: 1 / (1 + sqrt d) for squared l2, 1 - d / 2 for cosine, 1 / (1 + e ** d) for dot."""
    return {"l2sq": lambda: 1 / (1 + F.sqrt(d)), "cosine": lambda: 1 - d / 2, "dot": lambda: 1 / (1 + F.exp(d))}[metric]()
