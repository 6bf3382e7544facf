"""Structured Streaming forms of the batch operators: live queries, de-duplication, latest state, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import filtered, projected
from ..plans.spec import QuerySpec


def live(stream: DataFrame, spec: QuerySpec) -> DataFrame:
    """The rows of a stream that satisfy a query's predicates (stream mode), projected."""
    return projected(filtered(stream, spec, "stream"), spec)


def subscribe(stream: DataFrame, spec: QuerySpec, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls handle with each micro-batch of matching rows."""
    return live(stream, spec).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first event of each key within the delay; state older than the watermark goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, size: str, keys: list[str], delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by key and window of event time; late events within the delay count."""
    place = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(place.alias("window"), *keys).agg(F.count("*").alias("n"))


def latest_into(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str, parts: int = 16):
    """Keeps the latest row of each key in a Parquet folder, in parts by a hash of the key.

    A micro-batch reads and writes only the parts that its keys lie in; the others are taken over by name. state(target) has the rows.
    """
    from ..operators.changelog import latest
    from ..operators.lakehouse import Table

    def merge(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, target)
        last = table.current()
        if last is not None and last.summary.get("batch", -1) >= number:
            return  # this batch has been merged before a restart
        rows = batch.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        hit = [r[0] for r in rows.select(PART).distinct().collect()]  # at most `parts`
        kept = [f for f in last.files if int(f.partition[PART]) not in hit] if last else []
        touched = [f for f in last.files if int(f.partition[PART]) in hit] if last else []
        whole = rows.unionByName(table._scan(touched, last)) if touched else rows
        made = table._write(latest(whole, [*keys, PART], order), [PART])
        table._next(last, "merge", kept + made, (last.schema if last else rows.schema.json()), [PART], batch=number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The partition column of a state.
PART = "__part"


def state(spark, target: str) -> DataFrame:
    """The rows that latest_into() keeps."""
    from ..operators.lakehouse import Table

    return Table(spark, target).read().drop(PART)


def buffered_into(stream: DataFrame, buffer, checkpoint: str, clock: Callable[[], float]):
    """Hands each micro-batch to a change buffer, which writes to its tables by its own rule; call buffer.flush() at the end."""
    return stream.writeStream.foreachBatch(lambda batch, _: buffer.add(batch, clock()) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
