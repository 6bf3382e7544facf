"""Change logs: latest state, cursors, de-duplication, clocks, conflicts and mergeable values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], order: list[str], op: str | None = None, delete: str = "DELETE") -> DataFrame:
    """The last change of each key, without keys whose last change is a delete.

    max_by over all columns sums in the tasks first, so a hot key is one row a task in the shuffle.
    """
    rest = [c for c in changes.columns if c not in keys]
    out = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")
    return (out.where(F.col(op) != delete) if op else out).select(*changes.columns)


def cursors(changes: DataFrame, source: str, lsn: str) -> DataFrame:
    """Least and greatest sequence number and count of each source."""
    return changes.groupBy(source).agg(F.min(lsn).alias("min_lsn"), F.max(lsn).alias("max_lsn"), F.count("*").alias("n"))


def beyond(changes: DataFrame, done: DataFrame, source: str, lsn: str) -> DataFrame:
    """Changes past each source's cursor (done: source, max_lsn)."""
    return changes.join(done.select(source, F.col("max_lsn").alias("__done")), source, "left").where(F.col("__done").isNull() | (F.col(lsn) > F.col("__done"))).drop("__done")


def deduplicated(changes: DataFrame, keys: list[str], time: str, seconds: int, span: int = 3600) -> DataFrame:
    """The first of the changes of a key that follow each other within so many seconds.

    A key's changes are looked at by spans of time (no shorter than the gap), each with the last change of the span before it, so
    however many changes a key has, a task sorts those of one span.
    """
    at = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    rows = changes.withColumns({"__at": at, "__span": F.floor(at / (max(seconds, span, 1) * 1_000_000))})
    last = rows.groupBy(*keys, "__span").agg(F.max("__at").alias("__before")).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("__span") + 1).alias("__next"), "__before")
    same = [rows[f"`{k}`"].eqNullSafe(last[f"__k{i}"]) for i, k in enumerate(keys)]
    joined = rows.join(last, [*same, rows["__span"] == last["__next"]], "left")
    window = Window.partitionBy(*[f"`{k}`" for k in keys], "__span").orderBy("__at")
    gap = F.col("__at") - F.coalesce(F.lag("__at").over(window), F.col("__before"))
    return joined.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > seconds * 1_000_000)).select(*[f"`{c}`" for c in changes.columns])


def numbered(changes: DataFrame, lsn: str) -> DataFrame:
    """changes, or an error if a sequence number is negative or missing."""
    if not changes.where(F.col(lsn).isNull() | (F.col(lsn) < 0)).isEmpty():
        raise ValueError(f"{lsn} must not be negative or missing")
    return changes


def advanced(done: DataFrame, seen: DataFrame, source: str, expected: DataFrame | None = None) -> DataFrame:
    """Cursors after a batch (source, max_lsn): they never go back. With expected, only sources whose cursor is still that move."""
    both = done.select(source, "max_lsn").join(seen.select(source, F.col("max_lsn").alias("__seen")), source, "full")
    if expected is not None:
        both = both.join(expected.select(source, F.col("max_lsn").alias("__expected")), source, "left")
        moved = F.when(F.col("max_lsn").eqNullSafe(F.col("__expected")), F.greatest("max_lsn", "__seen")).otherwise(F.col("max_lsn"))
        return both.select(source, F.coalesce(moved, F.when(F.col("__expected").isNull(), F.col("__seen"))).alias("max_lsn")).where("max_lsn is not null")
    return both.select(source, F.greatest("max_lsn", "__seen").alias("max_lsn"))


@dataclass
class HybridClock:
    """A node's hybrid logical clock: wall time that never goes back, a counter within it, and the node."""

    node: str
    wall: int = 0
    counter: int = 0

    def now(self, wall: int) -> tuple[int, int, str]:
        """The time of an event of this node."""
        self.wall, self.counter = (wall, 0) if wall > self.wall else (self.wall, self.counter + 1)
        return self.wall, self.counter, self.node

    def receive(self, other: tuple[int, int, str], wall: int) -> tuple[int, int, str]:
        """The time of the arrival of another node's event: later than both."""
        most = max(self.wall, other[0], wall)
        held = [c for w, c in ((self.wall, self.counter), (other[0], other[1])) if w == most]
        self.wall, self.counter = most, max(held) + 1 if held else 0
        return self.wall, self.counter, self.node


def hybrid_clock(wall: Column, counter: Column, node: Column) -> Column:
    """A value that orders events by wall time, then counter, then node."""
    return F.struct(wall.alias("wall"), counter.alias("counter"), node.alias("node"))


def clock_merged(a: Column, b: Column) -> Column:
    """The larger count of each node of two vector clocks (maps)."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_within(a: Column, b: Column) -> Column:
    """Whether no node of a is ahead of b."""
    ahead = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) <= F.coalesce(y, F.lit(0)))
    return F.forall(F.map_values(ahead), lambda x: x)


def clock_order(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    return F.when(clock_within(a, b) & clock_within(b, a), "equal").when(clock_within(a, b), "before").when(clock_within(b, a), "after").otherwise("concurrent")


def conflicts(local: DataFrame, remote: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """Pairs of changes of a key with concurrent clocks."""
    right = remote.select(*keys, *[F.col(c).alias(f"remote_{c}") for c in remote.columns if c not in keys])
    return local.join(right, keys).where(clock_order(F.col(clock), F.col(f"remote_{clock}")) == "concurrent")


def resolved(pairs: DataFrame, fields: list[str], strategy: str | Callable[[Column, Column], Column], time: str = "ts") -> DataFrame:
    """What conflicts come to: last (remote wins ties), local, remote, merge (field by field, null gives way), or both.

    A function of the local and the remote value decides each field by itself. With both, each conflict is two rows, named by side.
    """
    keep = [c for c in pairs.columns if c not in fields and not c.startswith("remote_")]
    if strategy == "both":
        sides = [F.struct(F.lit(side).alias("side"), *[F.col(f"{prefix}{f}").alias(f) for f in fields]) for side, prefix in (("local", ""), ("remote", "remote_"))]
        return pairs.select(*keep, F.explode(F.array(*sides)).alias("__side")).select(*keep, "__side.*")
    later = F.col(f"remote_{time}") >= F.col(time) if strategy in ("last", "merge") else F.lit(strategy == "remote")

    def value(f: str) -> Column:
        local, remote = F.col(f), F.col(f"remote_{f}")
        if callable(strategy):
            return strategy(local, remote)
        chosen = F.when(later, remote).otherwise(local)
        return F.coalesce(chosen, local, remote) if strategy == "merge" else chosen

    if not callable(strategy) and strategy not in ("last", "local", "remote", "merge"):
        raise ValueError(f"unknown strategy: {strategy}")
    return pairs.select(*keep, *[value(f).alias(f) for f in fields])


def last_writer(changes: DataFrame, keys: list[str], value: str, time: str, node: str) -> DataFrame:
    """The value written last of each key (ties: the larger node); null is a deletion and drops the key."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(time, node)).alias("w")).select(*keys, f"w.{value}").where(F.col(value).isNotNull())


def last_writer_map(changes: DataFrame, keys: list[str], entry: str, value: str, time: str, node: str) -> DataFrame:
    """For each key the map of its entries, each written last; an entry whose last value is null is deleted."""
    last = last_writer(changes, [*keys, entry], value, time, node)
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(entry, value)))).alias("entries"))


def grow_counter(states: DataFrame, keys: list[str], node: str, count: str) -> DataFrame:
    """The sum over nodes of each node's largest count."""
    return states.groupBy(*keys, node).agg(F.max(count).alias("__n")).groupBy(*keys).agg(F.sum("__n").alias("total"))


def up_down_counter(states: DataFrame, keys: list[str], node: str, up: str, down: str) -> DataFrame:
    return states.groupBy(*keys, node).agg(F.max(up).alias("__u"), F.max(down).alias("__d")).groupBy(*keys).agg((F.sum("__u") - F.sum("__d")).alias("total"))


def applied(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str], op: str) -> DataFrame:
    """A state after a change log: rows without changes stay, others have their last change or are gone."""
    last = latest(changes, keys, order)
    return state.join(last.select(*keys), keys, "left_anti").unionByName(last.where(F.col(op) != "DELETE").select(*state.columns))


def selected(df: DataFrame, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The part of a table that takes part in a synchronisation."""
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


@dataclass
class FlushRule:
    """When a buffer is written out: at so many changes, bytes or seconds since its first change. Any one is enough; None never is."""

    changes: int | None = 10_000
    bytes: int | None = None
    seconds: float | None = None

    def due(self, changes: int, size: int, age: float) -> bool:
        return any(most is not None and now >= most for now, most in ((changes, self.changes), (size, self.bytes), (age, self.seconds)))


@dataclass
class ChangeBuffer:
    """Changes of many tables on their way to versioned tables, staged as files in a shared folder until a rule says so.

    A change counts once: those at or below their source's cursor are dropped. Only counts and cursors are kept by the driver.
    """

    spark: SparkSession
    folder: str
    tables: dict[str, object]  # versioned tables by name
    source: str = "source"
    lsn: str = "lsn"
    table: str = "table"
    rule: FlushRule = field(default_factory=FlushRule)
    cursors: dict[str, int] = field(default_factory=dict)
    staged: list[str] = field(default_factory=list)
    changes: int = 0
    size: int = 0
    since: float | None = None

    def add(self, batch: DataFrame, now: float) -> bool:
        """Stages a batch; writes out and returns True if the rule says so."""
        numbered(batch, self.lsn)
        if self.cursors:
            done = self.spark.createDataFrame(list(self.cursors.items()), f"{self.source} string, max_lsn long")
            batch = beyond(batch, done, self.source, self.lsn).select(*batch.columns)
        batch = batch.dropDuplicates([self.source, self.lsn])
        path = f"{self.folder}/staged-{len(self.staged)}-{now:.6f}"
        batch.write.parquet(path)
        back = self.spark.read.schema(batch.schema).parquet(path)
        rows = back.groupBy(self.source).agg(F.max(self.lsn).alias("top"), F.count("*").alias("n")).collect()  # one a source
        for r in rows:
            self.cursors[r[0]] = max(self.cursors.get(r[0], -1), r["top"])
        if rows:
            self.staged.append(path)
            self.changes += sum(r["n"] for r in rows)
            self.size += back.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
            self.since = now if self.since is None else self.since
        return self.tick(now)

    def tick(self, now: float) -> bool:
        """Writes out if the rule says so."""
        if self.since is None or not self.rule.due(self.changes, self.size, now - self.since):
            return False
        self.flush()
        return True

    def flush(self) -> dict[str, int]:
        """Appends what is staged to its tables; returns the changes of each."""
        out: dict[str, int] = {}
        if self.staged:
            whole = self.spark.read.parquet(*self.staged)
            for name, target in self.tables.items():
                own = whole.where(F.col(self.table) == name).drop(self.table)
                if not own.isEmpty():
                    out[name] = target.append(own).summary["added_rows"]
        self.staged, self.changes, self.size, self.since = [], 0, 0, None
        return out
