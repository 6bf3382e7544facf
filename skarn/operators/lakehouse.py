"""Versioned tables: files with statistics, snapshots, as-of reads, transactions, backups and compaction.

A table is a folder of Parquet files and a log. Each snapshot is a JSON document under a name that must not exist yet, so two
writers of the same version cannot both succeed. It holds what it adds and removes; every FULL_EVERY snapshots, and where
expiry takes a chain's beginning away, the whole list of files is written beside it, so that a read loads a few documents
however long the history is. Everything goes through Hadoop's file systems, so any store that Spark reads will do. Snapshots
are metadata of the driver; rows never are.

Updates and deletes rewrite the files that hold matching rows and no others. A table has one set of partition columns at a
time; every write and every compaction keeps it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta, timezone
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sets import promoted

SMALL_FILE = 1 << 20
FULL_EVERY = 20
#: Types whose least and greatest values are kept.
ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "timestamp", "timestamp_ntz", "boolean")
#: A folder of one write; as a partition's name it lets one read take the files of many writes.
WRITE = "_write"
#: Bytes of a partition by the way it is served.
SIZES = {"small": 2 << 20, "standard": 500 << 20, "large": 5 << 30}


@dataclass(frozen=True)
class DataFile:
    """A file, its rows and bytes; by column least, greatest (NaN apart), nulls and NaNs; its own schema where the table's is wider."""

    path: str
    rows: int
    size: int
    partition: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)
    schema: str | None = None
    written: float = 0.0


@dataclass
class Snapshot:
    id: int
    parent: int | None
    time: float
    operation: str
    files: list[DataFile]
    schema: str
    summary: dict = field(default_factory=dict)
    partition_by: list[str] = field(default_factory=list)

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _plain(value: Any) -> Any:
    """A value as JSON keeps it: dates and times as ISO text."""
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def _typed(value: Any, kind: str) -> Any:
    """A kept or given value as one that compares with others of the column's type; None if it is of another type."""
    try:
        if kind == "date":
            return value.date() if isinstance(value, datetime) else value if isinstance(value, date) else date.fromisoformat(value)
        if kind == "timestamp":  # microseconds; a time without a zone is of this process's zone, as Spark's literals are
            return value if isinstance(value, int) else (value.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        if kind == "timestamp_ntz":
            return value if isinstance(value, datetime) else datetime(value.year, value.month, value.day) if isinstance(value, date) else datetime.fromisoformat(value)
        if kind == "string":
            return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else None  # Spark orders text by its bytes
        if kind == "boolean":
            return value if isinstance(value, bool) else None
        return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    except (TypeError, ValueError, AttributeError):
        return None


def _partition_value(text: str | None, kind: str) -> Any:
    if text is None:
        return None
    try:
        return int(text) if kind in ("tinyint", "smallint", "int", "bigint") else float(text) if kind in ("float", "double") else text == "true" if kind == "boolean" else text
    except ValueError:
        return None


@dataclass(frozen=True)
class Bounds:
    """What a column's values in a file can be; low and high are None where it has nulls (and NaNs) only."""

    kind: str
    low: Any
    high: Any
    nulls: int
    nans: int
    rows: int


def bounds(file: DataFile, column: str, schema: StructType | None = None) -> Bounds | None:
    """From the partition, which has one value, or from the statistics; None where nothing is known."""
    kind = schema[column].dataType.simpleString() if schema is not None and column in schema.fieldNames() else None
    if column in file.partition:
        kind = kind or "string"
        value = _typed(_partition_value(file.partition[column], kind), kind)
        if value is None and file.partition[column] is not None:
            return None
        return Bounds(kind, value, value, file.rows if value is None else 0, 0, file.rows)
    if column not in file.stats:
        return None
    low, high, nulls, *rest = file.stats[column]
    kind = rest[1] if len(rest) > 1 else kind or ("string" if isinstance(low, str) else "double")
    nans = rest[0] if rest else 0
    low, high = (_typed(x, kind) if x is not None else None for x in (low, high))
    return Bounds(kind, low, high, nulls, nans, file.rows)


def may_match(file: DataFile, column: str, op: str, value: Any, schema: StructType | None = None) -> bool:
    """Whether a file can hold rows that satisfy the comparison, here (null sorts first, NaN fails) or in Spark (NaN sorts last).

    What cannot be compared, as a literal of another type, never rules a file out.
    """
    b = bounds(file, column, schema)
    if b is None:
        return True
    if op == "isNull":
        return b.nulls > 0
    if op == "isNotNull":
        return b.nulls < b.rows
    if op in ("ne", "notIn", "like"):
        return True
    if op == "in":
        return any(may_match(file, column, "eq", v, schema) for v in value or ())
    if op == "between":
        if value is None or len(value) != 2:
            return False
        return may_match(file, column, "gte", value[0], schema) and may_match(file, column, "lte", value[1], schema)
    if value is None:
        return {"eq": b.nulls > 0, "gt": b.nulls < b.rows, "gte": True, "lt": False, "lte": b.nulls > 0}[op]
    if isinstance(value, float) and math.isnan(value):
        return b.nans > 0 or op != "eq"
    wanted = _typed(value, b.kind)
    if wanted is None:
        return True
    if op in ("lt", "lte") and b.nulls or op in ("gt", "gte") and b.nans:
        return True
    if b.low is None or b.high is None:
        return False
    return {"eq": b.low <= wanted <= b.high, "gt": b.high > wanted, "gte": b.high >= wanted, "lt": b.low < wanted, "lte": b.low <= wanted}[op]


def pruned(snapshot: Snapshot, where: Iterable[tuple]) -> list[DataFile]:
    """The files that can match all tests (column, operator, value): partitions first, then statistics."""
    schema = snapshot.struct
    tests = sorted(where, key=lambda t: t[0] not in snapshot.partition_by)
    return [f for f in snapshot.files if all(may_match(f, *test, schema) for test in tests)]


def selectivity(snapshot: Snapshot, column: str, op: str, value: Any) -> float:
    """The share of rows that a comparison may keep, by bounds alone and as if values lay evenly between them."""
    schema, kept, rows = snapshot.struct, 0.0, sum(f.rows for f in snapshot.files)
    for f in snapshot.files:
        b, share = bounds(f, column, schema), 1.0
        if not may_match(f, column, op, value, schema):
            share = 0.0
        elif b is not None and op in ("gt", "gte", "lt", "lte", "between") and b.kind not in ("string", "boolean") and b.low is not None and b.low != b.high:
            number = lambda x: (x - (date(1970, 1, 1) if b.kind == "date" else datetime(1970, 1, 1))).total_seconds() if isinstance(x, (date, datetime)) else float(x)  # noqa: E731, B023
            low, high = number(b.low), number(b.high)
            ends = [_typed(v, b.kind) for v in (value if op == "between" else [value])]
            if None not in ends:
                at = [min(max((number(v) - low) / (high - low), 0.0), 1.0) for v in ends]
                share = at[1] - at[0] if op == "between" else 1 - at[0] if op in ("gt", "gte") else at[0]
        kept += f.rows * share
    return kept / rows if rows else 0.0


def pruning_report(snapshot: Snapshot, where: list[tuple]) -> dict:
    """What each test and all of them rule out: files, rows and bytes, and the tests that no file has bounds for."""
    schema = snapshot.struct
    count = lambda files: {"files": len(files), "rows": sum(f.rows for f in files), "bytes": sum(f.size for f in files)}
    whole, kept = count(snapshot.files), count(pruned(snapshot, where))
    tests = []
    for test in where:
        own = count([f for f in snapshot.files if may_match(f, *test, schema)])
        by = "partition" if test[0] in snapshot.partition_by else "statistics" if any(bounds(f, test[0], schema) for f in snapshot.files) else "none"
        tests.append({"test": tuple(test), "by": by, "kept": own, "selectivity": selectivity(snapshot, *test)})
    return {"all": whole, "kept": kept, "skipped": {k: whole[k] - kept[k] for k in whole}, "tests": tests, "useless": [t["test"] for t in tests if t["kept"]["files"] == whole["files"]]}


class PruneIndex:
    """Files by exact partition value and by sorted least value of some columns, for many lookups in a long list of files."""

    def __init__(self, snapshot: Snapshot, columns: Iterable[str]):
        self.snapshot, self.schema = snapshot, snapshot.struct
        self.by: dict[str, tuple[list, list, list[DataFile]]] = {}
        self.exact: dict[str, dict[Any, list[DataFile]]] = {}
        for c in columns:
            known = [(bounds(f, c, self.schema), f) for f in snapshot.files]
            if any(b is None or b.nans for b, _ in known):
                continue  # files without bounds match everything: no index
            if all(c in f.partition for f in snapshot.files):
                self.exact[c] = defaultdict(list)
                for b, f in known:
                    self.exact[c][b.low].append(f)
                continue
            ordered = sorted(((b.low, b.high, i) for i, (b, _) in enumerate(known) if b.low is not None))
            highest, top = [], None
            for _, high, _ in ordered:
                top = high if top is None or high > top else top
                highest.append(top)
            self.by[c] = ([low for low, _, _ in ordered], highest, [known[i][1] for _, _, i in ordered])

    def find(self, column: str, op: str, value: Any) -> list[DataFile]:
        """As pruning by one test; eq and between on an indexed column look at a range of files only."""
        from bisect import bisect_left, bisect_right

        kind = self.schema[column].dataType.simpleString() if column in self.schema.fieldNames() else "string"
        ends = [_typed(v, kind) for v in (value if op == "between" else [value])] if op in ("eq", "between") and value is not None else [None]
        if None in ends:
            return pruned(self.snapshot, [(column, op, value)])
        if column in self.exact and op == "eq":
            return list(self.exact[column].get(ends[0], ()))
        if column not in self.by:
            return pruned(self.snapshot, [(column, op, value)])
        lows, highest, files = self.by[column]
        first = bisect_left(highest, ends[0])  # no file before it reaches the lower end
        return [f for f in files[first : bisect_right(lows, ends[-1])] if may_match(f, column, op, value, self.schema)]


def problems(snapshot: Snapshot, exists: Callable[[str], bool] | None = None) -> list[str]:
    """What is wrong with a snapshot's list of files."""
    out, seen = [], set()
    names = snapshot.struct.fieldNames()
    for f in snapshot.files:
        say = lambda what: out.append(f"{f.path}: {what}")  # noqa: E731, B023
        if f.path in seen:
            say("listed twice")
        seen.add(f.path)
        if f.rows < 0 or f.size <= 0:
            say("no rows or bytes")
        if set(f.partition) != set(snapshot.partition_by):
            say("other partition columns than the table's")
        for c, (low, high, nulls, *rest) in f.stats.items():
            kind = rest[1] if len(rest) > 1 else "double"
            if c not in names:
                say(f"statistics of an unknown column {c}")
            if not 0 <= nulls + (rest[0] if rest else 0) <= f.rows:
                say(f"more nulls than rows in {c}")
            if low is not None and high is not None and not _typed(low, kind) <= _typed(high, kind):
                say(f"least value above greatest in {c}")
        if exists is not None and not exists(f.path):
            say("missing")
    return out


def changed(old: Snapshot, new: Snapshot) -> dict[str, list[str]]:
    """File names that a snapshot adds, removes and keeps."""
    a, b = {f.path for f in old.files}, {f.path for f in new.files}
    return {"added": sorted(b - a), "removed": sorted(a - b), "unchanged": sorted(a & b)}


def delta(old: list[DataFile], new: list[DataFile]) -> dict[str, list]:
    """What leads from one list of files to another."""
    before, after = {f.path for f in old}, {f.path for f in new}
    return {"added": [f for f in new if f.path not in before], "removed": [f.path for f in old if f.path not in after]}


def with_delta(files: list[DataFile], change: dict[str, list]) -> list[DataFile]:
    gone = set(change["removed"])
    return [f for f in files if f.path not in gone] + list(change["added"])


def ancestors(snapshots: list[Snapshot], id: int | None) -> list[int]:
    """A snapshot's ids up to the first, itself included."""
    by, out = {s.id: s for s in snapshots}, []
    while id is not None and id in by:
        out.append(id)
        id = by[id].parent
    return out


def common_ancestor(snapshots: list[Snapshot], a: int, b: int) -> int | None:
    """The latest snapshot that both come from."""
    held = set(ancestors(snapshots, a))
    return next((x for x in ancestors(snapshots, b) if x in held), None)


def path_between(snapshots: list[Snapshot], a: int, b: int) -> list[int] | None:
    """Ids from one snapshot up to the common ancestor and down to the other; None if they share none."""
    top = common_ancestor(snapshots, a, b)
    if top is None:
        return None
    up, down = ancestors(snapshots, a), ancestors(snapshots, b)
    return up[: up.index(top) + 1] + down[: down.index(top)][::-1]


def depth(snapshots: list[Snapshot], id: int) -> int:
    return len(ancestors(snapshots, id)) - 1


def roots(snapshots: list[Snapshot]) -> list[int]:
    known = {s.id for s in snapshots}
    return [s.id for s in snapshots if s.parent not in known]


def evolved(old: str, new: StructType) -> str:
    """A table's schema after rows of another one: new columns behind, types promoted."""
    known, out = StructType.fromJson(json.loads(old)), StructType()
    for f in known:
        kind = promoted(f.dataType, new[f.name].dataType) if f.name in new.fieldNames() else f.dataType
        out = out.add(f.name, kind, True, f.metadata)
    for f in new:
        if f.name not in known.fieldNames():
            out = out.add(f.name, f.dataType, True, f.metadata)
    return out.json()


class Table:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the log
    def _names(self) -> list[str]:
        log = self._path(f"{self.folder}/_log")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(log)) if self._fs.exists(log) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/_log/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, given: dict) -> None:
        """Fails if the name exists."""
        stream = self._fs.create(self._path(f"{self.folder}/_log/{name}"), False)
        try:
            stream.write(bytearray(json.dumps(given).encode()))
        finally:
            stream.close()

    def ids(self) -> list[int]:
        """Ids of all snapshots, oldest first."""
        return [int(n.split(".")[0]) for n in self._names() if n.endswith(".json") and not n.endswith(".full.json")]

    def _snapshots(self, wanted: set[int]) -> list[Snapshot]:
        """Some snapshots, oldest first, from the nearest whole list below the first of them on."""
        if not wanted:
            return []
        names, ids = set(self._names()), self.ids()
        full = lambda i: f"{i:012d}.full.json"
        first = max((i for i in ids if i <= min(wanted) and full(i) in names), default=None)
        found, files = [], []
        for i in ids:
            if first is not None and i < first or i > max(wanted):
                continue
            given = self._load(f"{i:012d}.json")
            change = {"added": [DataFile(**f) for f in given.pop("added")], "removed": given.pop("removed")}
            files = [DataFile(**f) for f in self._load(full(i))["files"]] if full(i) in names else with_delta(files, change)
            if i in wanted:
                found.append(Snapshot(**given, files=files))
        return found

    def snapshots(self) -> list[Snapshot]:
        """All snapshots, oldest first."""
        return self._snapshots(set(self.ids()))

    def _commit(self, s: Snapshot, before: list[DataFile] | None = None) -> Snapshot:
        change = delta(before or [], s.files)
        given = asdict(s)
        del given["files"]
        whole = before is None or s.id % FULL_EVERY == 0
        self._save(f"{s.id:012d}.json", {**given, "added": [asdict(f) for f in change["added"]], "removed": change["removed"]})
        if whole:
            self._save(f"{s.id:012d}.full.json", {"files": [asdict(f) for f in s.files]})
        return s

    def chain(self) -> dict:
        """How the log is kept: snapshots, whole lists, and how many deltas the current snapshot is made of."""
        names, ids = self._names(), self.ids()
        whole = [int(n.split(".")[0]) for n in names if n.endswith(".full.json")]
        return {"snapshots": len(ids), "whole": len(whole), "deltas": sum(1 for i in ids if not whole or i > max(whole))}

    def current(self) -> Snapshot | None:
        ids = self.ids()
        return self._snapshots({ids[-1]})[0] if ids else None

    def as_of(self, id: int | None = None, at: float | None = None) -> Snapshot:
        """The snapshot of an id, or the latest not after a time."""
        if id is not None:
            match = self._snapshots({id} & set(self.ids()))
        else:
            times = [(i, self._load(f"{i:012d}.json")["time"]) for i in self.ids()] if at is not None else [(i, 0.0) for i in self.ids()]
            match = self._snapshots(set([i for i, t in times if at is None or t <= at][-1:]))
        if not match:
            raise KeyError("no such snapshot")
        return match[-1]

    # writing
    def _write(self, df: DataFrame, partition_by: list[str], bloom: Iterable[str] = ()) -> list[DataFile]:
        """Writes df; statistics come from one pass over the new files, grouped by file."""
        place = f"{self.folder}/data/{WRITE}={uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        for c in bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(place)
        back = self.spark.read.schema(df.schema).parquet(place)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        plain = [c for c, k in kinds.items() if k in ORDERED and c not in partition_by]
        measures = [F.count("*").alias("n")]
        for i, c in enumerate(plain):
            value = F.col(f"`{c}`")
            nan = F.coalesce(F.isnan(value), F.lit(False)) if kinds[c] in ("float", "double") else F.lit(False)
            sure = F.when(~nan, F.unix_micros(value) if kinds[c] == "timestamp" else value.cast("double") if kinds[c] == "float" else value)
            measures += [F.min(sure).alias(f"lo_{i}"), F.max(sure).alias(f"hi_{i}"), F.count_if(value.isNull()).alias(f"no_{i}"), F.count_if(nan).alias(f"nan_{i}")]
        keys = [F.col(f"`{p}`").cast("string").alias(f"p_{i}") for i, p in enumerate(partition_by)]
        rows = back.groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), *keys).agg(*measures).collect()
        own, now, out = df.schema.json(), time.time(), []
        for r in rows:
            stats = {c: [_plain(r[f"lo_{i}"]), _plain(r[f"hi_{i}"]), r[f"no_{i}"], r[f"nan_{i}"], kinds[c]] for i, c in enumerate(plain)}
            out.append(DataFile(unquote(r["f"]), r["n"], r["s"], {p: r[f"p_{i}"] for i, p in enumerate(partition_by)}, stats, own, now))
        return out

    def _next(self, last: Snapshot | None, operation: str, files: list[DataFile], schema: str, partition_by: list[str], **summary) -> Snapshot:
        totals = {"files": len(files), "total_rows": sum(f.rows for f in files)}
        new = Snapshot(last.id + 1 if last else 1, last.id if last else None, time.time(), operation, files, schema, {**summary, **totals}, partition_by)
        return self._commit(new, last.files if last else None)

    def append(self, df: DataFrame, partition_by: Iterable[str] | None = None, bloom: Iterable[str] = ()) -> Snapshot:
        """Rows with more columns or wider types widen the table's schema; bloom names columns that get bloom filters."""
        last = self.current()
        by = list(partition_by) if partition_by is not None else last.partition_by if last else []
        if last and by != last.partition_by:
            raise ValueError(f"the table is partitioned by {last.partition_by}")
        new = self._write(df, by, bloom)
        schema = df.schema.json() if last is None else evolved(last.schema, df.schema)
        return self._next(last, "append", (last.files if last else []) + new, schema, by, added=len(new), added_rows=sum(f.rows for f in new))

    def insert(self, df: DataFrame) -> Snapshot:
        """Appends documents; those without an _id get one, made of the row's contents and place."""
        if "_id" not in df.columns:
            df = df.withColumn("_id", F.expr("uuid()"))
        else:
            df = df.withColumn("_id", F.coalesce(F.col("_id").cast("string"), F.expr("uuid()")))
        return self.append(df)

    def overwrite(self, df: DataFrame, partition_by: Iterable[str] | None = None) -> Snapshot:
        last = self.current()
        by = list(partition_by) if partition_by is not None else last.partition_by if last else []
        new, old = self._write(df, by), last.files if last else []
        return self._next(last, "overwrite", new, df.schema.json(), by, added=len(new), added_rows=sum(f.rows for f in new), removed=len(old), removed_rows=sum(f.rows for f in old))

    def _rewritten(self, base: Snapshot, test: Column, change: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFile], list[DataFile], int]:
        """Of base: the files without matches, new files in place of the others, and how many rows match."""
        name = WRITE + "_file"
        found = self._scan(base.files, base, name).where(test).groupBy(name).agg(F.count("*").alias("n")).collect() if base.files else []
        hit = {unquote(r[name]): r["n"] for r in found}
        touched = [f for f in base.files if f.path in hit]
        rest = [f for f in base.files if f.path not in hit]
        new = self._write(change(self._scan(touched, base)), base.partition_by) if touched else []
        return rest, [f for f in new if f.rows], sum(hit.values())

    def _updated(self, base: Snapshot, where: Column, values: dict) -> tuple[list[DataFile], dict]:
        test = F.coalesce(where, F.lit(False))
        new = lambda c: values[c] if isinstance(values[c], Column) else F.lit(values[c])
        kinds = {f.name: f.dataType for f in base.struct}
        cell = lambda c: F.when(test, new(c)).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in values else F.col(f"`{c}`")
        rest, made, n = self._rewritten(base, test, lambda df: df.select(*[cell(c) for c in df.columns]))
        return rest + made, {"updated_rows": n, "added": len(made), "removed": len(base.files) - len(rest)}

    def _deleted(self, base: Snapshot, where: Column) -> tuple[list[DataFile], dict]:
        test = F.coalesce(where, F.lit(False))
        rest, made, n = self._rewritten(base, test, lambda df: df.where(~test))
        return rest + made, {"deleted_rows": n, "added": len(made), "removed": len(base.files) - len(rest)}

    def _base(self) -> Snapshot:
        last = self.current()
        if last is None:
            raise KeyError("the table is empty")
        return last

    def update(self, where: Column, values: dict) -> Snapshot:
        """Sets columns of the matching rows to literals or expressions."""
        last = self._base()
        files, summary = self._updated(last, where, values)
        return self._next(last, "update", files, last.schema, last.partition_by, **summary)

    def delete(self, where: Column) -> Snapshot:
        last = self._base()
        files, summary = self._deleted(last, where)
        return self._next(last, "delete", files, last.schema, last.partition_by, **summary)

    def transaction(self) -> Transaction:
        return Transaction(self)

    # reading
    def _scan(self, files: list[DataFile], snapshot: Snapshot, name: str | None = None) -> DataFrame:
        """One read for all files of the table's own types, one more for each other schema; name: a column with each row's file."""
        schema = snapshot.struct
        if not files:
            return self.spark.createDataFrame([], schema)
        by: dict[str, list[str]] = defaultdict(list)
        for f in files:
            own = StructType.fromJson(json.loads(f.schema)) if f.schema else schema
            same = all(x.dataType == schema[x.name].dataType for x in own if x.name in schema.fieldNames())
            by["" if same else f.schema].append(f.path)
        parts = []
        for own, paths in sorted(by.items()):
            kinds = StructType.fromJson(json.loads(own)) if own else schema
            df = self.spark.read.schema(kinds).option("basePath", f"{self.folder}/data").parquet(*paths)
            cells = [(F.col(f"`{x.name}`") if x.name in kinds.fieldNames() else F.lit(None)).cast(x.dataType).alias(x.name) if own else F.col(f"`{x.name}`") for x in schema]
            parts.append(df.select(*cells, *([F.col("_metadata.file_path").alias(name)] if name else [])))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def read(self, snapshot: Snapshot | None = None, where: Iterable[tuple] = ()) -> DataFrame:
        """A snapshot's rows; files that cannot match where (column, operator, value) are left out before Spark sees them."""
        snapshot = snapshot or self._base()
        return self._scan(pruned(snapshot, list(where)), snapshot)

    def totals(self, snapshot: Snapshot | None = None) -> dict[str, int]:
        """Files, rows and bytes, from metadata alone."""
        files = (snapshot or self._base()).files
        return {"files": len(files), "rows": sum(f.rows for f in files), "bytes": sum(f.size for f in files)}

    def range_of(self, column: str, snapshot: Snapshot | None = None) -> tuple[Any, Any, int]:
        """Least and greatest value and nulls of a column, from metadata alone."""
        snapshot = snapshot or self._base()
        found = [bounds(f, column, snapshot.struct) for f in snapshot.files]
        if None in found:
            raise KeyError(f"no statistics of {column}")
        text = lambda x: x.decode("utf-8", "surrogatepass") if isinstance(x, bytes) else x
        lows, highs = [b.low for b in found if b.low is not None], [b.high for b in found if b.high is not None]
        return text(min(lows, default=None)), text(max(highs, default=None)), sum(b.nulls for b in found)

    def partitions(self, snapshot: Snapshot | None = None) -> dict[tuple, int]:
        """Rows of each partition, from metadata alone."""
        out: dict[tuple, int] = defaultdict(int)
        for f in (snapshot or self._base()).files:
            out[tuple(sorted(f.partition.items()))] += f.rows
        return dict(out)

    def checksum(self, snapshot: Snapshot | None = None) -> tuple[int, int]:
        """Rows and a sum of row hashes that does not depend on their order."""
        df = self.read(snapshot)
        row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0))).first()
        return row[0], int(row[1])

    def problems(self) -> list[str]:
        return problems(self._base(), lambda path: self._fs.exists(self._path(path)))

    # backups
    def backup(self, folder: str, snapshot: Snapshot | None = None) -> Table:
        """A snapshot's rows in another folder, checked against the source.

        The first backup copies all rows; a later one into the same folder copies the files that are new since and drops those that
        are gone, as the copy remembers which of its files stand for which.
        """
        snapshot = snapshot or self._base()
        copy, last = Table(self.spark, folder), None
        last = copy.current()
        known: dict[str, list[str]] = last.summary.get("sources", {}) if last else {}
        kept = {path: names for path, names in known.items() if path in {f.path for f in snapshot.files}}
        fresh = [f for f in snapshot.files if f.path not in kept]
        held = {name for names in kept.values() for name in names}
        files = [f for f in last.files if f.path in held] if last else []
        for f in fresh:
            made = copy._write(self._scan([f], snapshot), snapshot.partition_by)
            kept[f.path] = [x.path for x in made]
            files += made
        kind = "incremental" if last else "full"
        copy._next(last, "backup", files, snapshot.schema, snapshot.partition_by, kind=kind, of=snapshot.id, copied=len(fresh), sources=kept)
        if copy.checksum() != self.checksum(snapshot):
            raise ValueError("the copy differs from its source")
        return copy

    def restore(self, copy: Table, snapshot: Snapshot | None = None) -> Snapshot:
        """Makes a backup's rows the next snapshot."""
        source = snapshot or copy._base()
        out = self.overwrite(copy.read(source), source.partition_by)
        if self.checksum() != copy.checksum(source):
            raise ValueError("the restored rows differ from the backup")
        return out

    # upkeep
    def compaction_groups(self, small: int = SMALL_FILE, strategy: str = "size", most: int = 128 << 20, least_files: int = 2) -> dict[tuple, list[DataFile]]:
        """Files to join, by partition: small ones, taken by a strategy until most bytes are picked.

        size: the smallest first; time: the oldest first; lsn: by the least value of the column lsn; none: nothing.
        """
        order = {"size": lambda f: f.size, "time": lambda f: f.written, "lsn": lambda f: f.stats.get("lsn", [0])[0] or 0}
        if strategy == "none":
            return {}
        groups: dict[tuple, list[DataFile]] = defaultdict(list)
        last = self.current()
        for f in sorted((f for f in last.files if f.size < small), key=order[strategy]) if last else []:
            key = tuple(sorted(f.partition.items()))
            if sum(x.size for x in groups[key]) + f.size <= max(most, small):
                groups[key].append(f)
        return {k: v for k, v in groups.items() if len(v) >= max(least_files, 2)}

    def compaction_plan(self, target: int = 128 << 20, **how) -> dict:
        """What a compaction would do: files and bytes joined, and into how many."""
        groups = self.compaction_groups(**how)
        files = [f for g in groups.values() for f in g]
        return {"partitions": len(groups), "files": len(files), "bytes": sum(f.size for f in files), "into": sum(max(1, -(-sum(f.size for f in g) // target)) for g in groups.values())}

    def compact(self, target: int = 128 << 20, small: int = SMALL_FILE, **how) -> Snapshot | None:
        """Joins small files of a partition into few of about the target size; partitions and rows stay as they are."""
        last, groups = self.current(), self.compaction_groups(small, **how)
        if not groups:
            return None
        picked = [f for g in groups.values() for f in g]
        names = {f.path for f in picked}
        df = self._scan(picked, last)
        count = sum(max(1, -(-sum(f.size for f in g) // target)) for g in groups.values())
        keys = [F.col(f"`{p}`") for p in last.partition_by]
        if keys:  # the rows of a partition in as many tasks as it needs files, however large one of them is
            need = max(max(1, -(-sum(f.size for f in g) // target)) for g in groups.values())
            keys.append(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(need)))
        new = self._write(df.repartition(count, *keys) if keys else df.repartition(count), last.partition_by)
        if sum(f.rows for f in new) != sum(f.rows for f in picked):
            raise ValueError("compaction would change the number of rows")
        return self._next(last, "compact", [f for f in last.files if f.path not in names] + new, last.schema, last.partition_by, joined=len(picked), into=len(new))

    def expire(self, keep_last: int = 1, older_than: float | None = None, keep_ids: tuple[int, ...] = ()) -> tuple[list[int], list[str]]:
        """Drops old snapshots from the log; returns them and the files that no snapshot needs any more (deleted)."""
        found = self.snapshots()
        gone = [s for i, s in enumerate(found) if i < len(found) - keep_last and s.id not in keep_ids and (older_than is None or s.time < older_than)]
        dropped, names = {s.id for s in gone}, set(self._names())
        kept = [s for s in found if s.id not in dropped]
        for s in kept:  # a snapshot whose chain loses a link keeps its whole list
            if s.parent in dropped and f"{s.id:012d}.full.json" not in names:
                self._save(f"{s.id:012d}.full.json", {"files": [asdict(f) for f in s.files]})
        held = {f.path for s in kept for f in s.files}
        orphans = sorted({f.path for s in gone for f in s.files} - held)
        for s in gone:
            for end in (".json", ".full.json"):
                self._fs.delete(self._path(f"{self.folder}/_log/{s.id:012d}{end}"), False)
        for path in orphans:
            self._fs.delete(self._path(path), False)
        return [s.id for s in gone], orphans


class Transaction:
    """Changes that become one snapshot or none; savepoints take back what came after them. Rows are read as of its beginning.

    Another writer's snapshot in the meantime makes commit fail: its name exists.
    """

    def __init__(self, table: Table):
        self.table, self.begun = table, table.current()
        self.now, self.log, self.points = self.begun, [], {}
        self.done = False

    def _step(self, operation: str, files: list[DataFile], schema: str, by: list[str], summary: dict) -> Transaction:
        if self.done:
            raise ValueError("the transaction has ended")
        last = self.begun
        self.now = Snapshot(last.id + 1 if last else 1, last.id if last else None, time.time(), operation, files, schema, summary, by)
        self.log = [*self.log, {"operation": operation, **summary}]
        return self

    def append(self, df: DataFrame, partition_by: Iterable[str] | None = None) -> Transaction:
        by = list(partition_by) if partition_by is not None else self.now.partition_by if self.now else []
        new = self.table._write(df, by)
        schema = evolved(self.now.schema, df.schema) if self.now else df.schema.json()
        return self._step("append", (self.now.files if self.now else []) + new, schema, by, {"added_rows": sum(f.rows for f in new)})

    def update(self, where: Column, values: dict) -> Transaction:
        files, summary = self.table._updated(self.now, where, values)
        return self._step("update", files, self.now.schema, self.now.partition_by, summary)

    def delete(self, where: Column) -> Transaction:
        files, summary = self.table._deleted(self.now, where)
        return self._step("delete", files, self.now.schema, self.now.partition_by, summary)

    def read(self) -> DataFrame:
        return self.table.read(self.now)

    def savepoint(self, name: str) -> Transaction:
        self.points[name] = (self.now, self.log)
        return self

    def rollback_to(self, name: str) -> Transaction:
        self.now, self.log = self.points[name]
        return self

    def rollback(self) -> None:
        self.now, self.log, self.done = self.begun, [], True

    def commit(self) -> Snapshot | None:
        if self.done:
            raise ValueError("the transaction has ended")
        self.done = True
        if not self.log:
            return self.begun
        return self.table._next(self.begun, "transaction", self.now.files, self.now.schema, self.now.partition_by, steps=self.log)


@dataclass
class Upkeep:
    """Compaction when enough small files or enough time has come together; the caller's clock calls tick()."""

    table: Table
    least_files: int = 4
    every: float = 60.0
    soon: float = 1.0
    size: str = "standard"
    strategy: str = "size"
    next_at: float = 0.0

    def tick(self, now: float | None = None) -> Snapshot | None:
        """Compacts if it is time and there is work; then looks again soon, else after the usual wait."""
        now = time.time() if now is None else now
        if now < self.next_at:
            return None
        target = target_bytes(self.size, self.table.totals()["bytes"] if self.table.current() else 0)
        made = self.table.compact(target, small=max(target // 2, 2), strategy=self.strategy, least_files=self.least_files, most=max(target, SMALL_FILE))
        self.next_at = now + (self.soon if made else self.every)
        return made


def target_bytes(size: str = "tiered", total: int = 0) -> int:
    """Bytes of a partition for a way of serving; tiered chooses it by the table's bytes."""
    if size == "tiered":
        size = "small" if total < SIZES["standard"] else "standard" if total < SIZES["large"] else "large"
    return SIZES[size]
