"""Files in and out: Parquet, CSV, TSV and JSON with fixed rules for quotes, blanks and nulls; other formats by registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All values are text, quotes are doubled, missing fields are empty strings; a file without rows under its header is an error."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', sep=separator, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df.fillna("")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects."""
    return spark.read.json(path, multiLine=True, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, with_id: bool = False) -> None:
    (df if with_id else df.drop("_id")).write.csv(path, header=True, escape='"', nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str, with_id: bool = False) -> None:
    (df if with_id else df.drop("_id")).write.json(path, ignoreNullFields=False)


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table below a folder: name.parquet, or all files of the folder name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(f"{folder}/{name}.parquet" if fs.exists(path) else f"{folder}/{name}")


def by_ids(df: DataFrame, key: str, ids: DataFrame | None = None, exclude: bool = False, where: Column | None = None) -> DataFrame:
    """The rows whose key is in ids (or is not), and for which where holds."""
    df = df.where(where) if where is not None else df
    return df if ids is None else df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti" if exclude else "left_semi")


#: Readers of formats: (spark, path, options) to a DataFrame.
READERS: dict[str, Callable[..., DataFrame]] = {"parquet": lambda spark, path: spark.read.parquet(path), "csv": read_csv, "tsv": read_tsv, "json": read_json}


def register_reader(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a format that engines can attach."""
    if kind in READERS:
        raise ValueError(f"format {kind} exists")
    READERS[kind] = reader
