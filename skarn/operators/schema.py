"""Schemas of documents: inference, promotion, compatibility, evolution, validation, shredding to (path, value) and back."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, IntegerType, MapType, NullType, NumericType, StringType, StructField, StructType

from ..functions.paths import steps
from .sets import promoted

DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
#: Patterns of formats that have one; url and iso-datetime are tested by what can be parsed.
FORMATS = {
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "iso-date": r"^\d{4}-\d{2}-\d{2}$",
}
#: Objects and arrays within each other that a document may have.
MAX_DEPTH = 64
#: What a type may widen to.
WIDER = {"int": ("bigint", "double", "float"), "bigint": ("double",), "float": ("double",)}


def value_type(value: Any) -> DataType:
    """The type of one leaf value: whole numbers of 32 bits are int, other numbers double, dates by their form."""
    if value is None:
        return NullType()
    if isinstance(value, bool):
        return BooleanType()
    if isinstance(value, int):
        return IntegerType() if abs(value) < 1 << 31 else DoubleType()
    if isinstance(value, float):
        return DoubleType()
    return DateType() if isinstance(value, str) and DATE.match(value) else StringType()


def has_format(c: Column, name: str) -> Column:
    """Whether a text has a format: a URL has a scheme and something behind it, a date and time is any that can be parsed."""
    if name == "url":
        return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$") & (~c.rlike(r"^(?i)(https?|ftp|wss?|file):") | c.rlike(r"^(?i)(?:file:|[a-z]+:/*[^\s/?#]+)"))
    if name == "iso-datetime":
        return c.try_cast("timestamp").isNotNull()
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return c.rlike(FORMATS[name])


def json_depth(text: Column) -> Column:
    """How many objects and arrays stand within each other at most, by the brackets outside of strings."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*+"', ""), r"[^\[\]{}]+", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(brackets, zero, step, lambda s: s["most"])


def shred_long(df: DataFrame, keys: list[str], text: str, columns: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row for each leaf of a JSON document: keys, path (a.b, a[0]), kind and value as text. Empty objects and arrays vanish.

    With columns, only these paths and what lies below them; nothing else is walked. The deepest document is looked for first;
    if it is deeper than max_depth, that is an error. Then the JSON is parsed once, as a variant, and every level is one generator
    through which leaves pass and containers are opened, so each document is walked once, whatever its depth, without a schema. Only
    what is left at the end is asked for its kind: that of a container is the schema of all below it.
    """
    given = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    deepest = given.where(F.expr("try_parse_json(__text) is not null")).agg(F.max(json_depth(F.col("__text")))).first()[0] or 0
    if deepest > max_depth:
        raise ValueError(f"documents are {deepest} levels deep, more than {max_depth}")
    names = ", ".join(f"`{k}`" for k in keys)
    parsed = given.select(*[F.col(f"`{k}`") for k in keys], F.explode(F.array(F.expr("try_parse_json(__text)"))).alias("v"))  # once a document
    step = parsed.where("v is not null").withColumn("path", F.lit(""))
    path = "case when t.pos is null then path when t.key is not null then if(path = '', t.key, concat(path, '.', t.key)) else concat(path, '[', t.pos, ']') end"
    for _ in range(deepest):
        view = f"__shred_{uuid.uuid4().hex}"
        step.createOrReplaceTempView(view)
        step = df.sparkSession.sql(f"select {names}, {path} as path, if(t.pos is null, v, t.value) as v from {view}, lateral variant_explode_outer(v) t")
        df.sparkSession.catalog.dropTempView(view)
        if columns is not None:
            ways = [F.col("path").isin(columns)]
            ways += [(F.col("path") == "") | F.lit(c).startswith(F.concat("path", F.lit("."))) | F.lit(c).startswith(F.concat("path", F.lit("["))) for c in columns]
            ways += [F.col("path").startswith(c + ".") | F.col("path").startswith(c + "[") for c in columns]
            step = step.where(reduce(lambda a, b: a | b, ways))
    leaf = step.withColumn("kind", F.expr("schema_of_variant(v)")).where("not (kind like 'OBJECT%' or kind like 'ARRAY%')")
    if columns is not None:
        leaf = leaf.where(reduce(lambda a, b: a | b, [(F.col("path") == c) | F.col("path").startswith(c + ".") | F.col("path").startswith(c + "[") for c in columns], F.lit(False)))
    return leaf.select(*[F.col(f"`{k}`") for k in keys], "path", F.lower("kind").alias("kind"), F.expr("try_variant_get(v, '$', 'string')").alias("value"))


def path_types(long: DataFrame) -> DataFrame:
    """For each path: rows, nulls and the promoted kind (one kind, else double for numbers, else string)."""
    number = F.col("kind").startswith("decimal") | F.col("kind").isin("bigint", "double", "float")
    base = F.when(F.col("kind") == "void", None).when(F.col("kind").startswith("decimal"), "double").otherwise(F.col("kind"))
    return long.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "void").alias("nulls"), F.count_distinct(base).alias("kinds"), F.bool_and(number | (F.col("kind") == "void")).alias("numeric"), F.min(base).alias("one")).select(
        "path", "n", "nulls", F.when(F.col("kinds") == 0, "void").when(F.col("kinds") == 1, F.col("one")).when(F.col("numeric"), "double").otherwise("string").alias("kind")
    )


def _document(leaves: list[tuple[str, str, str | None]]) -> str:
    """The JSON of a document from its leaves (path, kind, value): objects by name in the order of the paths, arrays by index."""
    root: Any = None
    for path, kind, value in sorted(leaves):
        leaf = _Raw("null" if value is None or kind == "void" else json.dumps(value, ensure_ascii=False) if kind == "string" or kind.startswith(("date", "timestamp", "binary")) else value)
        steps_ = steps(path)
        if not steps_:
            return leaf.text
        if root is None:
            root = {} if isinstance(steps_[0], str) else []
        at = root
        for i, step in enumerate(steps_):
            below = leaf if i == len(steps_) - 1 else [] if isinstance(steps_[i + 1], int) else {}
            if isinstance(at, list):
                at.extend([None] * (step + 1 - len(at)))
                at[step] = below if at[step] is None else at[step]
            else:
                at.setdefault(step, below)
            at = at[step]
    return _written({} if root is None else root)


class _Raw:
    """A value as it is written."""

    def __init__(self, text: str):
        self.text = text


def _written(node: Any) -> str:
    if isinstance(node, _Raw):
        return node.text
    if isinstance(node, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in node.items()) + "}"
    return "[" + ",".join(map(_written, node)) + "]" if isinstance(node, list) else "null"


def unshred(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys and document: the JSON of each document again, nested and with its types, from path, kind and value of its leaves.

    Names come in the order of their paths; an index that no leaf has is null. Depth has no bound that expressions could spell out,
    so a vectorised function builds the text of one document from its own leaves.
    """

    @F.pandas_udf("string")
    def build(leaves: pd.Series) -> pd.Series:
        return leaves.map(lambda rows: _document([(r["path"], r["kind"], r["value"]) for r in rows]))

    grouped = long.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.collect_list(F.struct("path", "kind", "value")).alias("__leaves"))
    return grouped.select(*[F.col(f"`{k}`") for k in keys], build("__leaves").alias("document"))


def schema_report(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """For each path of JSON documents: kind, in how many documents, nulls, and least and greatest length of the value as text."""
    long = shred_long(df, keys, text)
    about = long.groupBy("path").agg(F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"))
    return path_types(long).join(about, "path")


def infer(documents: list[dict], prefix: str = "") -> dict[str, DataType]:
    """Leaf paths and promoted types of sample documents."""
    found: dict[str, DataType] = {}

    def walk(value: Any, path: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]")
        else:
            kind = value_type(value)
            found[path] = promoted(found[path], kind) if path in found else kind

    for d in documents:
        walk(d, prefix)
    return found


def can_widen(a: DataType, b: DataType, to_text: bool = True) -> bool:
    return a == b or isinstance(a, NullType) or to_text and isinstance(b, StringType) or b.simpleString() in WIDER.get(a.simpleString(), ())


def compatible(old: StructType, new: StructType, mode: str = "backward") -> list[str]:
    """What breaks under a mode: backward (new reads old data), forward (old reads new data), full, none."""
    wrong: list[str] = []

    def reads(reader: StructType, writer: StructType, who: str) -> None:
        for f in reader:
            if f.name not in writer.fieldNames():
                if not f.nullable:
                    wrong.append(f"{who}: {f.name} is required and missing")
            elif not can_widen(writer[f.name].dataType, f.dataType, to_text=False):
                wrong.append(f"{who}: {f.name} cannot widen from {writer[f.name].dataType.simpleString()} to {f.dataType.simpleString()}")
            elif writer[f.name].nullable and not f.nullable:
                wrong.append(f"{who}: {f.name} became required")

    if mode in ("backward", "full"):
        reads(new, old, "backward")
    if mode in ("forward", "full"):
        reads(old, new, "forward")
    return wrong


@dataclass(frozen=True)
class Change:
    """kind: add, drop, rename, update_type, make_nullable, make_required or update_doc."""

    kind: str
    column: str
    argument: Any = None


def evolve(schema: StructType, changes: list[Change]) -> StructType:
    fields = {f.name: f for f in schema}
    order = list(fields)
    for c in changes:
        if c.kind == "add":
            if c.column in fields:
                raise ValueError(f"{c.column} exists")
            fields[c.column] = StructField(c.column, c.argument, True)
            order.append(c.column)
            continue
        if c.column not in fields:
            raise ValueError(f"{c.column} does not exist")
        f = fields[c.column]
        if c.kind == "drop":
            order.remove(c.column)
            del fields[c.column]
        elif c.kind == "rename":
            order[order.index(c.column)] = c.argument
            fields[c.argument] = StructField(c.argument, f.dataType, f.nullable, f.metadata)
            del fields[c.column]
        elif c.kind == "update_type":
            if not can_widen(f.dataType, c.argument, to_text=False):
                raise ValueError(f"{c.column} cannot become {c.argument.simpleString()}")
            fields[c.column] = StructField(f.name, c.argument, f.nullable, f.metadata)
        elif c.kind in ("make_nullable", "make_required"):
            fields[c.column] = StructField(f.name, f.dataType, c.kind == "make_nullable", f.metadata)
        elif c.kind == "update_doc":
            fields[c.column] = StructField(f.name, f.dataType, f.nullable, {**f.metadata, "comment": c.argument})
        else:
            raise ValueError(f"unknown change: {c.kind}")
    return StructType([fields[n] for n in order])


def read_as(df: DataFrame, changes: list[Change]) -> DataFrame:
    """Rows of the old schema under the changed one."""
    for c in changes:
        if c.kind == "add":
            df = df.withColumn(c.column, F.lit(None).cast(c.argument))
        elif c.kind == "drop":
            df = df.drop(c.column)
        elif c.kind == "rename":
            df = df.withColumnRenamed(c.column, c.argument)
        elif c.kind == "update_type":
            df = df.withColumn(c.column, F.col(f"`{c.column}`").cast(c.argument))
    return df


@dataclass(frozen=True)
class Rule:
    """What a field must satisfy."""

    required: bool = False
    kind: str | None = None
    enum: tuple = ()
    format: str | None = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None


VERSION = "_schemaVersion"


@dataclass
class DocumentSchema:
    """Rules by field, and a mode for what else documents have.

    locked and strict refuse unknown fields (strict names those there are); evolve lets them pass, and updates() lists them for the
    schema; versioned is locked, and a document's version must not be above the schema's: below it or missing is a warning.
    """

    rules: dict[str, Rule] = field(default_factory=dict)
    mode: str = "locked"
    version: int = 1

    def errors(self, df: DataFrame, partial: bool = False) -> Column:
        """An array of what is wrong with a row (partial: missing required fields are no error)."""
        out: list[Column] = []
        for name, rule in self.rules.items():
            if name not in df.columns:
                if rule.required and not partial:
                    out.append(F.lit(f"{name}: required"))
                continue
            c = F.col(f"`{name}`")
            say = lambda test, what, n=name: F.when(F.coalesce(test, F.lit(False)), F.lit(f"{n}: {what}"))
            if rule.required and not partial:
                out.append(say(c.isNull(), "required"))
            if rule.kind:
                out.append(say(c.isNotNull() & c.cast("string").try_cast(rule.kind).isNull(), f"not {rule.kind}"))
            if rule.enum:
                out.append(say(~c.isin(list(rule.enum)), "not listed"))
            if rule.format:
                out.append(say(~has_format(c.cast("string"), rule.format), f"not {rule.format}"))
            if rule.min is not None:
                out.append(say(c < rule.min, "too small"))
            if rule.max is not None:
                out.append(say(c > rule.max, "too large"))
            if rule.min_length is not None:
                out.append(say(F.length(c.cast("string")) < rule.min_length, "too short"))
            if rule.max_length is not None:
                out.append(say(F.length(c.cast("string")) > rule.max_length, "too long"))
        if self.mode != "evolve":
            more = f" (known: {', '.join(self.rules)})" if self.mode == "strict" else ""
            unknown = [n for n in df.columns if n not in self.rules and not (self.mode == "versioned" and n == VERSION)]
            out += [F.when(F.col(f"`{n}`").isNotNull(), F.lit(f"{n}: unknown{more}")) for n in unknown]
        if self.mode == "versioned" and VERSION in df.columns:
            out.append(F.when(F.col(f"`{VERSION}`").try_cast("int") > self.version, F.lit(f"{VERSION}: newer than {self.version}")))
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")

    def warnings(self, df: DataFrame) -> Column:
        """An array of what is no error: versions that are older or missing, fields that will become part of the schema."""
        out: list[Column] = []
        if self.mode == "versioned":
            found = F.col(f"`{VERSION}`").try_cast("int") if VERSION in df.columns else F.lit(None).cast("int")
            out.append(F.when(found.isNull(), F.lit(f"{VERSION}: will be {self.version}")).when(found < self.version, F.lit(f"{VERSION}: older than {self.version}")))
        if self.mode == "evolve":
            out += [F.when(F.col(f"`{n}`").isNotNull(), F.lit(f"{n}: new")) for n in df.columns if n not in self.rules]
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")

    def updates(self, df: DataFrame) -> dict[str, str]:
        """In mode evolve, the fields that the documents add and their types; fields without any value add nothing."""
        new = [f for f in df.schema if f.name not in self.rules] if self.mode == "evolve" else []
        if not new:
            return {}
        held = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(new)]).first()
        return {f.name: f.dataType.simpleString() for i, f in enumerate(new) if held[f"c{i}"]}

    def check(self, df: DataFrame, partial: bool = False) -> DataFrame:
        """df itself, or an error that names the first thing wrong: for writers that must not go on."""
        bad = df.select(F.explode(self.errors(df, partial)).alias("e")).limit(1).collect()
        if bad:
            raise ValueError(bad[0]["e"])
        return df

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Valid rows, and invalid ones with their errors."""
        marked = df.withColumn("_errors", self.errors(df))
        return marked.where(F.size("_errors") == 0).drop("_errors"), marked.where(F.size("_errors") > 0)


def describe(schema: StructType) -> str:
    """The schema as DDL."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)


def difference(old: StructType, new: StructType) -> dict[str, list[str]]:
    """Added, dropped and changed fields."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    return {"added": sorted(b.keys() - a.keys()), "dropped": sorted(a.keys() - b.keys()), "changed": sorted(n for n in a.keys() & b.keys() if a[n].dataType != b[n].dataType or a[n].nullable != b[n].nullable)}


#: How other languages name the types.
SCRIPT_TYPES = {"string": "string", "boolean": "boolean", "date": "Date", "timestamp": "Date", "timestamp_ntz": "Date", "binary": "Uint8Array"}


def to_interface(name: str, schema: StructType, indent: str = "  ") -> str:
    """The schema as a TypeScript interface."""

    def kind(t: DataType, pad: str) -> str:
        if isinstance(t, StructType):
            return "{\n" + "".join(f"{pad}{indent}{f.name}{'?' if f.nullable else ''}: {kind(f.dataType, pad + indent)};\n" for f in t) + pad + "}"
        if isinstance(t, ArrayType):
            return f"Array<{kind(t.elementType, pad)}>"
        if isinstance(t, MapType):
            return f"Record<string, {kind(t.valueType, pad)}>"
        return SCRIPT_TYPES.get(t.simpleString(), "number" if isinstance(t, NumericType) else "unknown")

    return f"export interface {name} {kind(schema, '')}"


def to_json_schema(schema: StructType) -> str:
    return json.dumps(json.loads(schema.json()), sort_keys=True)


