"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: An Arrow batch on its way to a Python worker holds about so many bytes of rows, as JVM and worker hold it several times over.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a folder of our own if all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def quoted(name: str) -> Column:
    """The column of that very name, whatever dots or quotes are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(names: list[str], wanted: str) -> str:
    """wanted, or wanted with lines behind it, such that no column has the name (case does not count)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on, Arrow batches of the session's Python stages hold at most so many bytes (a row that is longer is alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def hands_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and when it ends, the worker's free memory goes back to the system: workers live on from task to task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended: its folder is no longer ours to clean
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and any executor can be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skarn/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(schema).parquet(path)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # noqa: BLE001  the session has ended, and a session's own catalogue with it
        pass


def materialise_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """As materialise(), as a table in buckets of key: what needs the rows of a key together reads it without a shuffle."""
    spark, name = df.sparkSession, f"skarn_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/skarn/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    atexit.register(remove, spark, path)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Remove the files that materialise() wrote for df; nothing may read it afterwards."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/skarn/" in folder:
            remove(df.sparkSession, folder)


def free_shuffles(df: DataFrame) -> None:
    """Let the driver forget finished plans, so that executors drop their shuffle files; loops over many tables call it."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions (by keys if any)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """docs less the rows whose key is in ids (a column doc_id); rows without a key stay. A short list goes to all executors."""
    gone = fresh(docs.columns, "gone")
    ids = materialise(ids.select(F.col("doc_id").cast("long").alias(gone)).where(F.col(gone).isNotNull()).distinct(), "gone")
    ids = F.broadcast(ids) if ids.count() <= most else ids
    return docs.join(ids, quoted(key).cast("long") == F.col(gone), "left_anti")


def doc_remainder(modulus: int):
    """crc32 of doc_id's decimal text, modulo: the folds that keep labelled rows apart from training."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus
