"""Null rules, builder, plans, schemas, tables, streams."""

import json
import math
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, NullType, StringType, StructField, StructType

from skarn.functions.predicates import Predicate, predicate, tree_filter
from skarn.operators import changelog, lakehouse, schema, search, sets
from skarn.operators.builder import Engine
from skarn.operators.chains import Chain
from skarn.operators.lakehouse import Table
from skarn.plans import compile as plan
from skarn.plans.spec import QuerySpec
from skarn.sources import files
from skarn.streaming import streams

VALUES = [None, -1.5, 0.0, 2.0, 7.25, math.nan]


def model(op, x, v):
    """Two-valued comparisons: null equals null and is less than everything; nan is in no order."""
    low = lambda a: -math.inf if a is None else a
    if op == "eq":
        return x is None and v is None or x is not None and v is not None and (x == v or math.isnan(x) and math.isnan(v))
    if op == "ne":
        return not model("eq", x, v)
    if any(a is not None and math.isnan(a) for a in (x, v)):
        return False
    if op in ("gt", "lte"):
        more = low(x) > low(v) if (x is None) != (v is None) or x is not None else False
        return more if op == "gt" else not more
    less = low(x) < low(v) if (x is None) != (v is None) or x is not None else False
    return less if op == "lt" else not less


@pytest.mark.parametrize("op", ["eq", "ne", "gt", "gte", "lt", "lte"])
@pytest.mark.parametrize("literal", [None, -1.5, 2.0])
def test_comparisons_are_two_valued(spark, op, literal):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, x double")
    found = {r["i"] for r in df.where(predicate(df, Predicate("x", op, literal))).collect()}
    if literal is None and op in ("gt", "gte", "lt", "lte"):
        wanted = {i for i, v in enumerate(VALUES) if {"gt": v is not None, "gte": True, "lt": False, "lte": v is None}[op]}
    else:
        wanted = {i for i, v in enumerate(VALUES) if model(op, v, literal)}
    assert found == wanted


def test_filter_and_its_negation_divide_the_rows(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    for op, value in [("gt", 1.0), ("in", [2.0, None]), ("between", [0.0, 5.0]), ("isNull", None)]:
        assert df.where(predicate(df, Predicate("x", op, value))).count() + df.where(predicate(df, Predicate("x", op, value, True))).count() == len(VALUES)


def test_like_does_not_cross_lines_and_ignores_case(spark):
    df = spark.createDataFrame([("Abc",), ("a\nb",), ("a.c",), (None,)], "s string")
    assert [r["s"] for r in df.where(predicate(df, Predicate("s", "like", "a%c"))).collect()] == ["Abc", "a.c"]
    assert [r["s"] for r in df.where(predicate(df, Predicate("s", "like", "a.c"))).collect()] == ["a.c"]


def test_tree_filter_keeps_or_and_not(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (5, None)], "a int, b int")
    assert [r["a"] for r in df.where(tree_filter(df, {"OR": [{"a": 1}, {"b_isNull": True}]})).collect()] == [1, 5]
    assert [r["a"] for r in df.where(tree_filter(df, {"NOT": {"a": 1, "b": 2}})).collect()] == [3, 5]


def test_flat_name_wins_over_nesting_and_limit_zero(spark):
    df = spark.createDataFrame([((7,), 9)], "a struct<b:int>, `a.b` int")
    e = Engine(spark)
    e.register("t", df)
    assert e.table("t").select("a.b").to_df().collect() == [(9,)]
    assert e.table("t").limit(0).to_df().count() == 0
    with pytest.raises(KeyError):
        e.table("t").select("zz").to_df()


def test_having_on_alias_and_page_ahead(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"))
    spec = QuerySpec.of({"table": "t", "groupBy": ["k"], "aggregations": [{"function": "count", "alias": "n"}], "predicates": [{"column": "n", "op": "gt", "value": 3}]})
    assert plan.run(spec, df).collect() == [(0, 4)]
    rows, more = plan.page(QuerySpec("t", limit=4, offset=8), df)
    assert rows.count() == 2 and not more


def test_filters_reach_the_scan(spark):
    text = Engine(spark, "/root/testdata/sf0.001").table("orders").where("o_orderkey", "gt", 10).select("o_orderkey").explain()
    assert "PushedFilters" in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_promotion_and_append(spark):
    assert sets.promoted(IntegerType(), LongType()) == LongType() and sets.promoted(NullType(), StringType()) == StringType()
    out = sets.append_evolved(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x", 2.5)], "b string, a double"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1.0, None), (2.5, "x")]


def test_schema_changes_and_compatibility():
    old = StructType([StructField("a", IntegerType()), StructField("b", StringType())])
    new = schema.evolve(old, [schema.Change("update_type", "a", LongType()), schema.Change("rename", "b", "c"), schema.Change("add", "d", StringType())])
    assert new.fieldNames() == ["a", "c", "d"] and schema.compatible(old, new) == []
    assert schema.compatible(new, old) != []
    assert schema.difference(old, new) == {"added": ["c", "d"], "dropped": ["b"], "changed": ["a"]}
    with pytest.raises(ValueError):
        schema.evolve(new, [schema.Change("update_type", "a", IntegerType())])


def test_validation_lists_errors(spark):
    rules = schema.DocumentSchema({"mail": schema.Rule(required=True, format="email"), "age": schema.Rule(min=0, max=150)})
    df = spark.createDataFrame([("a@b.cd", 5, None), ("nope", 200, None), (None, 1, "x")], "mail string, age int, extra string")
    good, bad = rules.split(df)
    assert good.count() == 1
    assert sorted(map(sorted, (r["_errors"] for r in bad.collect()))) == [["age: too large", "mail: not email"], ["extra: unknown", "mail: required"]]


def test_shred_and_back(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}], "e": {}}, "d": "x"}'), (2, "broken"), (3, None), (4, "[1, [true]]"), (5, '{"s": "a{[\\"}"}')], "id int, doc string")
    found = {(r["id"], r["path"]): r["value"] for r in schema.shred_long(df, ["id"], "doc").collect()}
    assert found == {(1, "a.b[0]"): "1", (1, "a.b[1].c"): None, (1, "d"): "x", (4, "[0]"): "1", (4, "[1][0]"): "true", (5, "s"): 'a{["}'}
    back = {r["id"]: json.loads(r["document"]) for r in schema.unshred(schema.shred_long(df, ["id"], "doc"), ["id"]).collect()}
    assert back == {1: {"a": {"b": [1, {"c": None}]}, "d": "x"}, 4: [1, [True]], 5: {"s": 'a{["}'}}
    some = {(r["id"], r["path"]) for r in schema.shred_long(df, ["id"], "doc", columns=["a.b[1]", "s"]).collect()}
    assert some == {(1, "a.b[1].c"), (5, "s")}
    deep = "[" * 70 + "1" + "]" * 70
    with pytest.raises(ValueError):
        schema.shred_long(spark.createDataFrame([(1, deep)], "id int, doc string"), ["id"], "doc")
    assert {r["path"]: r["longest"] for r in schema.schema_report(df, ["id"], "doc").collect()}["d"] == 1


@settings(max_examples=1, deadline=None)
@given(st.lists(st.dictionaries(st.text("ab", min_size=1, max_size=2), st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text("xé\"\\\n", max_size=4)), lambda x: st.lists(x, min_size=1, max_size=3) | st.dictionaries(st.text("cd", min_size=1, max_size=2), x, min_size=1, max_size=3), max_leaves=8), min_size=1, max_size=3), min_size=40, max_size=40))
def test_documents_come_back(spark, documents):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "id int, doc string")
    back = {r["id"]: json.loads(r["document"]) for r in schema.unshred(schema.shred_long(df, ["id"], "doc"), ["id"]).collect()}
    assert back == dict(enumerate(documents))


def test_lock_modes_and_formats(spark):
    df = spark.createDataFrame([("a@b.cd", 1, "x", 1), (None, None, None, 3)], "mail string, n int, extra string, _schemaVersion int")
    of = lambda s: [r[0] for r in df.select(s.errors(df)).collect()]
    rules = {"mail": schema.Rule(format="email"), "n": schema.Rule()}
    assert of(schema.DocumentSchema(rules, "strict"))[0] == ["extra: unknown (known: mail, n)", "_schemaVersion: unknown (known: mail, n)"]
    versioned = schema.DocumentSchema({**rules, "extra": schema.Rule()}, "versioned", 2)
    assert of(versioned) == [[], ["_schemaVersion: newer than 2"]] and [r[0] for r in df.select(versioned.warnings(df)).collect()] == [["_schemaVersion: older than 2"], []]
    evolve = schema.DocumentSchema(rules, "evolve")
    assert of(evolve) == [[], []] and evolve.updates(df) == {"extra": "string", "_schemaVersion": "int"}
    with pytest.raises(ValueError, match="unknown"):
        schema.DocumentSchema(rules).check(df)
    words = spark.createDataFrame([("https://a.b/c",), ("mailto:a@b",), ("http:",), ("a b",), ("2024-01-01T10:00:00Z",), ("2024-01-01",)], "s string")
    assert [r[0] for r in words.select(schema.has_format(F.col("s"), "url")).collect()][:4] == [True, True, False, False]
    assert [r[0] for r in words.select(schema.has_format(F.col("s"), "iso-datetime")).collect()][3:] == [False, True, True]
    assert "name?: string" in schema.to_interface("T", StructType([StructField("name", StringType())]))


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.one_of(st.integers(), st.booleans(), st.text(max_size=5), st.none()), max_size=4))
def test_inferred_schema_holds_its_own_documents(document):
    kinds = schema.infer([document, document])
    assert set(kinds) == set(document) and all(sets.promoted(k, k) == k for k in kinds.values())


def test_versions_compaction_and_conflict(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    for k in range(3):
        table.append(spark.range(k * 10, k * 10 + 10))
    assert table.read().count() == 30 and table.read(table.as_of(id=1)).count() == 10
    assert table.read(where=[("id", "gte", 20)]).count() == 10
    before = table.current()
    made = table.update(F.col("id") < 5, {"id": 100})
    assert table.read().where("id = 100").count() == 5 and made.summary["updated_rows"] == 5
    kept = {f.path for f in before.files} & {f.path for f in made.files}
    assert sum(f.rows for f in made.files if f.path in kept) >= 20  # files without matches stay
    assert table.delete(F.col("id") == 100).summary["deleted_rows"] == 5
    with pytest.raises(Exception):
        table._commit(table.current())  # a version exists once
    table.append(spark.range(1000, 1010).withColumn("x", F.lit("new")))
    assert table.read().where("x is null").count() == 25
    table.compact()
    assert table.read().count() == 35 and table.problems() == []
    gone, orphans = table.expire(keep_last=1)
    assert len(gone) == 6 and orphans and table.read().count() == 35 and table.problems() == []


def test_partitioned_table_reads_its_partition_columns(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/p")
    table.append(spark.range(10).withColumn("k", (F.col("id") % 2).cast("int")), ["k"])
    table.append(spark.range(10, 14).withColumn("k", F.lit(7)), ["k"])
    table.append(spark.range(20, 24).withColumn("k", F.lit(None).cast("int")))
    wanted = {(0, 5), (1, 5), (7, 4), (None, 4)}
    counts = lambda: {tuple(r) for r in table.read().groupBy("k").count().collect()}
    assert counts() == wanted and {f.partition["k"] for f in lakehouse.pruned(table.current(), [("k", "eq", 7)])} == {"7"}
    assert table.compact() is not None and counts() == wanted and len(table.current().files) == 4
    table.update(F.col("id") == 3, {"k": 9})
    assert counts() == {(0, 5), (1, 4), (7, 4), (9, 1), (None, 4)}
    with pytest.raises(ValueError):
        table.append(spark.range(3).withColumn("k", F.lit(1)), [])
    names = Table(spark, f"file://{tmp_path}/names")
    names.append(spark.createDataFrame([(1, "a b%c/d"), (2, "é=1"), (3, "")], "i int, k string"), ["k"])
    names.update(F.col("i") == 1, {"i": 10})
    assert {tuple(r) for r in names.read().collect()} == {(10, "a b%c/d"), (2, "é=1"), (3, None)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True), st.integers(-3, 3).map(float)), min_size=1, max_size=6), st.sampled_from(["eq", "gt", "gte", "lt", "lte", "between", "in"]), st.floats(-4, 4))
def test_files_that_match_are_never_ruled_out(values, op, literal):
    plain = [v for v in values if v is not None and not math.isnan(v)]
    nulls, nans = values.count(None), sum(v is not None and math.isnan(v) for v in values)
    file = lakehouse.DataFile("f", len(values), 1, {}, {"x": [min(plain, default=None), max(plain, default=None), nulls, nans, "double"]})
    given = [literal, literal + 1] if op in ("between", "in") else literal
    tests = {"eq": lambda v: v == literal, "gt": lambda v: v > literal, "gte": lambda v: v >= literal, "lt": lambda v: v < literal, "lte": lambda v: v <= literal, "between": lambda v: given[0] <= v <= given[1], "in": lambda v: v in given}
    matches = any(tests[op](v) for v in plain) or op in ("gt", "gte") and nans or op in ("lt", "lte") and nulls
    assert lakehouse.may_match(file, "x", op, given) or not matches
    assert lakehouse.may_match(file, "x", op, "text") or op in ("between",)


def test_bounds_of_dates_times_and_fractions(spark, tmp_path):
    from datetime import date, datetime

    rows = [(i, date(2024, 1, i + 1), datetime(2024, 1, i + 1, 5), 0.1 * i) for i in range(9)]
    table = Table(spark, f"file://{tmp_path}/d")
    for part in (rows[:5], rows[5:]):
        table.append(spark.createDataFrame(part, "i int, d date, ts timestamp, f float").withColumn("ntz", F.col("ts").cast("timestamp_ntz")).coalesce(1))
    count = lambda *t: len(lakehouse.pruned(table.current(), [t]))
    assert count("d", "lt", date(2024, 1, 3)) == 1 and count("d", "gte", "2024-01-05") == 2 and count("ts", "gt", datetime(2024, 1, 6)) == 1
    assert count("ntz", "between", [datetime(2024, 1, 1), datetime(2024, 1, 2)]) == 1 and count("d", "eq", 5) == 2
    own = table.read().agg(F.max("f")).first()[0]
    assert count("f", "gte", own) == 1 and table.read(where=[("f", "gte", own)]).where(F.col("f") >= own).count() == 1
    assert table.range_of("d") == (date(2024, 1, 1), date(2024, 1, 9), 0)
    report = lakehouse.pruning_report(table.current(), [("d", "lt", date(2024, 1, 3)), ("i", "gte", 0)])
    assert report["skipped"] == {"files": 1, "rows": 4, "bytes": report["all"]["bytes"] - report["kept"]["bytes"]} and report["useless"] == [("i", "gte", 0)]
    index = lakehouse.PruneIndex(table.current(), ["i", "d"])
    for test in [("i", "eq", 3), ("i", "between", [4, 5]), ("d", "eq", date(2024, 1, 9)), ("i", "gt", 7)]:
        assert {f.path for f in index.find(*test)} == {f.path for f in lakehouse.pruned(table.current(), [test])}
    assert 0.4 < lakehouse.selectivity(table.current(), "i", "lt", 4) < 0.6


def test_log_of_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lakehouse, "FULL_EVERY", 4)
    table = Table(spark, f"file://{tmp_path}/log")
    for k in range(10):
        table.append(spark.range(k, k + 1).coalesce(1))
    assert table.chain() == {"snapshots": 10, "whole": 3, "deltas": 2}
    assert [len(s.files) for s in table.snapshots()] == list(range(1, 11)) and len(table.as_of(id=7).files) == 7
    gone, _ = table.expire(keep_last=2, keep_ids=(3,))
    assert len(gone) == 7 and [len(s.files) for s in table.snapshots()] == [3, 9, 10] and table.read(table.as_of(id=3)).count() == 3
    found = table.snapshots()
    assert lakehouse.roots(found) == [3, 9] and lakehouse.path_between(found, 10, 9) == [10, 9] and lakehouse.common_ancestor(found, 3, 10) is None and lakehouse.depth(found, 10) == 1


def test_transactions_and_backups(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    table.append(spark.range(10))
    one, two = table.transaction(), table.transaction()
    one.delete(F.col("id") < 3).savepoint("a").append(spark.range(100, 105)).rollback_to("a").update(F.col("id") == 5, {"id": 50})
    assert one.read().count() == 7 and table.read().count() == 10
    made = one.commit()
    assert made.id == 2 and [x["operation"] for x in made.summary["steps"]] == ["delete", "update"] and table.read().where("id = 50").count() == 1
    with pytest.raises(Exception):
        two.append(spark.range(5)).commit()  # another writer was first
    with pytest.raises(ValueError):
        one.append(spark.range(1))
    table.backup(f"file://{tmp_path}/b")
    table.append(spark.range(7, 9))
    copy = table.backup(f"file://{tmp_path}/b")
    assert copy.current().summary["kind"] == "incremental" and copy.current().summary["copied"] < len(table.current().files) and copy.checksum() == table.checksum()
    table.delete(F.lit(True))
    assert table.read().count() == 0 and table.restore(copy).summary["total_rows"] == 9


def test_compaction_strategies_and_upkeep(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/c")
    for k in range(5):
        table.append(spark.range(k * 10, k * 10 + 10).withColumn("lsn", F.col("id")).coalesce(1))
    first = lambda s: [f.stats["lsn"][0] for g in table.compaction_groups(strategy=s).values() for f in g]
    assert first("lsn") == [0, 10, 20, 30, 40] == first("time") and first("none") == [] and table.compaction_groups(least_files=6) == {}
    assert table.compaction_plan()["files"] == 5 and table.compaction_plan()["into"] == 1
    upkeep = lakehouse.Upkeep(table, least_files=4, size="small")
    assert upkeep.tick(100.0).summary["joined"] == 5 and upkeep.tick(100.5) is None and upkeep.tick(101.0) is None and upkeep.next_at == 161.0
    assert lakehouse.target_bytes("tiered", 600 << 20) == 500 << 20 and lakehouse.target_bytes("small") == 2 << 20


def test_insert_makes_ids_and_widens(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/i")
    table.insert(spark.createDataFrame([("x", 1), (None, 2)], "_id string, n int"))
    table.insert(spark.createDataFrame([(2.5, "t")], "n double, more string"))
    rows = table.read().collect()
    assert sorted(r["n"] for r in rows) == [1.0, 2.0, 2.5] and len({r["_id"] for r in rows}) == 3 and "x" in {r["_id"] for r in rows}


def test_vector_clocks(spark):
    df = spark.createDataFrame([({"a": 1}, {"a": 2}), ({"a": 1, "b": 2}, {"a": 2}), ({"a": 1}, {"a": 1})], "x map<string,int>, y map<string,int>")
    assert [r[0] for r in df.select(changelog.clock_order(F.col("x"), F.col("y"))).collect()] == ["before", "concurrent", "equal"]


def test_query_parser():
    q = search.parse('red "blue sky" -green lang:en pre* colr~ OR NOT grey -"a b" title:"c d" e-f')
    assert not q.every and [(p.kind, p.words, p.field, p.excluded) for p in q.parts] == [
        ("word", ["red"], None, False), ("phrase", ["blue", "sky"], None, False), ("word", ["green"], None, True), ("word", ["en"], "lang", False), ("prefix", ["pre"], None, False), ("near", ["colr"], None, False),
        ("word", ["grey"], None, True), ("phrase", ["a", "b"], None, True), ("phrase", ["c", "d"], "title", False), ("phrase", ["e", "f"], None, False),
    ]


def test_prefix_and_near_words_without_a_cap_or_a_switch(spark):
    """80 terms of a prefix, AND kept beside a prefix, scores by the whole corpus whatever is excluded."""
    docs = spark.createDataFrame([(i, f"red pre{i:02d}") for i in range(80)] + [(100, "blue pre00"), (101, "red sky green"), (102, "reed")], "id int, text string")
    ids = lambda q, **how: {r["id"] for r in search.search(docs, "id", "text", q, None).collect()}
    assert ids("pre*") == {*range(80), 100} and ids("red sk*") == {101} and ids("blue OR sk*") == {100, 101} and ids("red~ sky") == {101}
    score = lambda q: {r["id"]: r["score"] for r in search.search(docs, "id", "text", q, None).collect()}
    assert score("red")[1] == score("red -green")[1] and 101 not in score("red -green")


def test_stored_index(spark, tmp_path):
    rows = [(1, "Running dogs", "the dog runs"), (2, "cats", "a running joke about cats"), (3, "dogs", "nothing"), (4, None, "runners run")]
    docs = spark.createDataFrame(rows, "id int, title string, body string")
    index = search.TextIndex.build(docs, "id", {"title": 10.0, "body": 1.0}, f"file://{tmp_path}/index", language="english")
    ids = lambda q, **how: [r["id"] for r in index.search(q, None, **how).collect()]
    assert set(ids("run")) == {1, 2, 4} and ids("dog")[0] == 3 and set(ids("dog")) == {1, 3} and ids("the") == []
    assert ids("title:running") == [1] and ids('"running joke"') == [2] and ids("run NOT cats dog") == [1] and set(ids("cats OR dogs")) == {1, 2, 3}
    assert ids("dogs", docs=docs, exact_boost=5.0)[0] == 3 and ids("run", docs=docs, where=F.col("id") > 3) == [4]
    first = index.search("dogs", docs=docs, exact_boost=5.0).first()["score"]
    assert first == pytest.approx(5 * {r["id"]: r["score"] for r in index.search("dogs", None).collect()}[3])
    assert {r["id"] for r in index.search("run", None, scorer=search.tf_idf).collect()} == {1, 2, 4} and len(ids("run", offset=1)) == 2
    assert search.TextIndex(spark, f"file://{tmp_path}/index").terms().where("term = 'dog'").first()["df"] == 2


def test_stems_and_stop_words(spark):
    from skarn.functions import stems

    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll is".split()
    wanted = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt commun activ angular homolog effect bowdler probat rate ceas control roll is".split()
    df = spark.createDataFrame(list(zip(words, strict=True)), "w string")
    assert [r[0] for r in df.select(stems.english_stem(F.col("w"))).collect()] == wanted
    es = spark.createDataFrame([("canciones",), ("hablando",), ("gatos",), ("el",), ("rapidamente",)], "w string")
    assert [r[0] for r in es.select(stems.stem(F.col("w"), "spanish")).collect()] == ["cancion", "habl", "gat", "el", "rapida"]
    assert "the" in stems.stop_words("english") and "und" in stems.stop_words("german") and stems.stop_words("none") == []


def test_chain_orders_its_steps(spark):
    chain = Chain().step("sum", lambda x: x.agg(F.sum("id").alias("s")), ("src",)).step("src", lambda: spark.range(4))
    assert chain.order() == ["src", "sum"] and chain.run()["sum"].first()["s"] == 6
    with pytest.raises(ValueError):
        Chain().step("a", lambda x: x, ("b",)).step("b", lambda x: x, ("a",)).order()


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 'say "hi", you', "1"), ("y", "", None)], "_id string, t string, n string")
    files.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(map(tuple, files.read_csv(spark, f"file://{tmp_path}/c").collect())) == [("", ""), ('say "hi", you', "1")]


def test_stream_of_latest_rows_is_the_batch_result(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(40)], "k int, lsn int, v string")
    for part in range(4):
        rows.where(F.col("lsn") % 4 == part).coalesce(1).write.parquet(f"file://{tmp_path}/in/p{part}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    target = f"{tmp_path}/out"
    run = streams.latest_into(source, ["k"], ["lsn"], f"file://{target}", f"file://{tmp_path}/check-{uuid.uuid4().hex}", parts=3)
    run.awaitTermination(120)
    assert sorted(map(tuple, streams.state(spark, f"file://{target}").collect())) == sorted(map(tuple, changelog.latest(rows, ["k"], ["lsn"]).collect()))
    assert [s.summary["batch"] for s in Table(spark, f"file://{target}").snapshots()] == [0, 1, 2, 3]


def test_streams_drop_repeats_and_count_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i % 3, start + timedelta(seconds=20 * i), f"e{i // 2}") for i in range(12)]
    spark.createDataFrame(rows, "k int, ts timestamp, id string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema("k int, ts timestamp, id string").parquet(f"file://{tmp_path}/in")

    def result(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert result(streams.deduplicated(source, ["id"], "ts"), "append", "once").count() == 6
    assert {r["n"] for r in result(streams.windowed(source, "ts", "1 minute", []), "complete", "counted").collect()} == {3}
    spec = QuerySpec.of({"table": "t", "predicates": [{"column": "k", "operator": ">", "value": 1}], "projection": ["id"]})
    assert result(streams.live(source, spec), "append", "live").count() == 4


def test_row_policies(spark):
    from skarn.operators.policy import Policies

    rules, df = Policies(), spark.range(6)
    assert rules.visible("t", df, {}).count() == 6
    rules.add("t", "select", lambda user: F.col("id") == user["id"])
    rules.add("t", "select", lambda user: F.col("id") > 4)
    assert [r[0] for r in rules.visible("t", df, {"id": 1}).collect()] == [1, 5]
    assert rules.visible("t", df, {"id": 1, "bypass": True}).count() == 6


def test_engine_guards_by_policies(spark, tmp_path):
    from skarn.operators.policy import Policies

    rules, table = Policies(), Table(spark, f"file://{tmp_path}/g")
    table.append(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "id int, owner int, s string"))
    rules.add("t", "select", lambda user: F.col("owner") == user["id"])
    rules.add("t", "all", lambda user: F.col("s") != "secret")
    e = Engine(spark, policies=rules)
    e.register("t", table)
    e.register("free", spark.range(3))
    assert e.table("free").to_df().count() == 3
    with pytest.raises(PermissionError):
        e.table("t").to_df()
    rules.rules[("t", "select")] = rules.rules[("t", "select")][:1]
    user = e.as_user({"id": 1})
    assert {r["id"] for r in user.table("t").collect()} == {1, 2}
    user.update("t", F.lit(True), {"s": "z"})
    assert {tuple(r) for r in table.read().collect()} == {(1, 1, "z"), (2, 1, "z"), (3, 2, "c")}
    with pytest.raises(PermissionError):
        user.insert("t", spark.createDataFrame([(4, 1, "secret")], "id int, owner int, s string"))
    user.delete("t", F.col("id") >= 2)
    assert {r["id"] for r in table.read().collect()} == {1, 3}


def test_engine_versions_relations_cache_and_timeout(spark, tmp_path):
    import time

    from skarn.operators.builder import QueryCache

    table = Table(spark, f"file://{tmp_path}/v")
    for k in range(3):
        table.append(spark.range(k * 5, k * 5 + 5))
    e = Engine(spark)
    e.register("v", table)
    e.register("owner", spark.createDataFrame([(0, "a"), (1, "b")], "key int, name string"))
    assert e.table("v").as_of_snapshot(2).to_df().count() == 10 and e.table("v").as_of(time.time()).to_df().count() == 15
    plan_ = e.table("v").where("id", "gte", 12).plan()
    assert plan_["files_read"] < plan_["files"] and plan_["steps"] == ["filter"] and plan_["snapshot"] == 3
    e.relate("items", "v", "id", "owner", "key")
    assert {r["id"]: r["items"]["name"] for r in e.related("items").where("id < 2").collect()} == {0: "a", 1: "b"}
    assert e.metadata("v")["rows"] == 15 and e.table("v").compute(d={"fn": "add", "args": ["id", {"lit": 1}]}).where("d", "gt", 14).count("n").first()["n"] == 1
    cache = QueryCache(e, seconds=100, most=2)
    spec = QuerySpec("v", limit=3)
    assert cache.run(spec).count() == 3 and cache.run(spec) is cache.run(spec) and (cache.hits, cache.misses) == (2, 1)
    table.append(spark.range(1))
    cache.run(spec)
    assert cache.misses == 2 and cache.invalidate("v*") == 2
    slow = spark.range(0, 3, 1, 1).select(F.udf(lambda x: __import__("time").sleep(20) or x, "long")("id").alias("x"))
    e.register("slow", slow)
    with pytest.raises(TimeoutError):
        e.table("slow").timeout(1.0).collect()


def test_literals_of_another_type_are_refused(spark):
    df = spark.createDataFrame([("5", 5, True, [1, 2])], "s string, n int, b boolean, a array<int>")
    for column, value in (("s", 5), ("n", "5"), ("b", 1), ("n", True)):
        with pytest.raises(TypeError):
            predicate(df, Predicate(column, "eq", value))
    assert df.where(predicate(df, Predicate("n", "like", "5%"))).count() == 0 and df.where(predicate(df, Predicate("a[1]", "eq", 2))).count() == 1
    assert df.where(predicate(df, Predicate("a[7]", "eq", None))).count() == 1


def test_change_buffer_and_clocks(spark, tmp_path):
    tables = {n: Table(spark, f"file://{tmp_path}/{n}") for n in ("a", "b")}
    buffer = changelog.ChangeBuffer(spark, f"file://{tmp_path}/staged", tables, rule=changelog.FlushRule(changes=5, seconds=60))
    batch = lambda rows: spark.createDataFrame(rows, "source string, lsn long, table string, v int")
    assert not buffer.add(batch([("s", 1, "a", 1), ("s", 2, "b", 2), ("s", 2, "b", 2)]), 0.0)
    assert not buffer.add(batch([("s", 2, "b", 2), ("s", 1, "a", 1)]), 1.0) and buffer.changes == 2  # seen before
    assert buffer.tick(61.0) and tables["a"].read().count() == 1 and tables["b"].read().count() == 1
    assert buffer.add(batch([("s", k, "a", k) for k in range(3, 9)]), 70.0) and tables["a"].read().count() == 7 and buffer.cursors == {"s": 8}
    with pytest.raises(ValueError):
        buffer.add(batch([("s", -1, "a", 0)]), 71.0)
    clock = changelog.HybridClock("n")
    assert [clock.now(5), clock.now(5), clock.now(4), clock.receive((9, 3, "m"), 7), clock.now(8), clock.receive((2, 0, "m"), 20)] == [(5, 0, "n"), (5, 1, "n"), (5, 2, "n"), (9, 4, "n"), (9, 5, "n"), (20, 0, "n")]
    done = spark.createDataFrame([("s", 5), ("t", 9)], "source string, max_lsn long")
    seen = spark.createDataFrame([("s", 4), ("u", 1)], "source string, max_lsn long")
    assert {tuple(r) for r in changelog.advanced(done, seen, "source").collect()} == {("s", 5), ("t", 9), ("u", 1)}
    pairs = spark.createDataFrame([(1, 5, 7, 1, 2)], "id int, v int, remote_v int, ts int, remote_ts int")
    assert {(r["side"], r["v"]) for r in changelog.resolved(pairs, ["v"], "both").collect()} == {("local", 5), ("remote", 7)}
    assert changelog.resolved(pairs, ["v"], lambda a, b: a + b).first()["v"] == 12


def test_gaps_across_spans(spark):
    """The same as one window over all of a key's changes."""
    import random

    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(4000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, s int, i int").withColumn("ts", F.timestamp_seconds("s"))
    for seconds, span in ((10, 60), (300, 60), (7, 7)):
        wanted, last = set(), {}
        for k, s, i in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            if k not in last or s - last[k] > seconds:
                wanted.add((k, s))
            last[k] = s
        assert {(r["k"], r["s"]) for r in changelog.deduplicated(df, ["k"], "ts", seconds, span).collect()} == wanted


def test_rows_steps(spark):
    from skarn.operators.rows import Rows

    rows = Rows(spark.range(10))
    assert rows.filter(F.col("id") > 3).map(x=F.col("id") * 2).reduce(s=F.sum("x"))["s"] == 78
    assert rows.some(F.col("id") == 9) and not rows.every(F.col("id") < 9) and rows.find(F.col("id") == 4)["id"] == 4
    assert rows.concat(rows).distinct("id").count() == 10 and [len(b) for b in rows.batches([F.col("id")], 4)] == [4, 4, 2]
    assert rows.take_while(F.col("id") < 3, [F.col("id")]).count() == 3 and rows.flat_map(F.array("id", "id"), "x").skip(5).take(9).count() == 9


def test_files_formats_and_command_line(spark, tmp_path, capsys):
    from skarn.__main__ import main

    (tmp_path / "a.json").write_text('[{"x": 1, "y": "ä"}, {"x": 2}]', encoding="utf-8")
    assert sorted(r["x"] for r in files.read_json(spark, f"file://{tmp_path}/a.json").collect()) == [1, 2]
    (tmp_path / "h.csv").write_text("a,b\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_csv(spark, f"file://{tmp_path}/h.csv")
    (tmp_path / "u.csv").write_text('a,b\né,"x, ""y"""\n', encoding="utf-8")
    e = Engine(spark)
    e.attach("u", "csv", f"file://{tmp_path}/u.csv")
    assert e.table("u").collect() == [("é", 'x, "y"')]
    files.write_json(spark.range(2), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    spark.range(3).write.parquet(f"file://{tmp_path}/data/t")
    assert Engine(spark, f"file://{tmp_path}/data").table("t").to_df().count() == 3
    one, two = str(tmp_path / "one.json"), str(tmp_path / "two.json")
    assert main(["pull", f"file://{tmp_path}/data/t", one]) == 0 and main(["lock", one, two]) == 0 and main(["diff", one, two]) == 0
    assert main(["push", one, two]) == 0 and main(["types", one]) == 0 and "id?: number" in capsys.readouterr().out
    path = spark.createDataFrame([("year=2024/k=a%20b/file",), ("k=__HIVE_DEFAULT_PARTITION__",)], "p string")
    from skarn.functions import scalar

    assert [r[0] for r in path.select(scalar.parsed_partition_path(F.col("p"))).collect()] == [{"year": "2024", "k": "a b"}, {"k": None}]


def test_vector_index_and_chains(spark, tmp_path):
    import numpy as np

    from skarn.operators import vectors

    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 16))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<float>")
    for metric in ("l2sq", "cosine"):
        index = vectors.ClusterIndex.build(e, "vec_id", "embedding", f"file://{tmp_path}/{metric}", lists=32, copies=3, metric=metric)
        assert index.rows.count() == 9000 and index.rows.select("vec_id").distinct().count() == 3000
        asked = {i: x[i].tolist() for i in range(0, 3000, 100)}
        exact = {(r["query"], r["vec_id"]) for r in vectors.batch_top_k(e.where("embedding is not null"), "vec_id", "embedding", asked, 10, metric).collect()}
        found = {(r["query"], r["vec_id"]) for r in index.search_batch(asked, 10, 8).collect()}
        coded = {(r["query"], r["vec_id"]) for r in index.search_batch(asked, 10, 8, rerank=100).collect()}
        assert len(found) == 300 and len(exact & found) >= 270 and len(exact & coded) >= 0.95 * len(exact & found)
        everywhere = {(r["query"], r["vec_id"]) for r in index.search_batch(asked, 10, 32).collect()}
        assert everywhere == exact
    one = [r["vec_id"] for r in index.search(x[5].tolist(), 3, 32, F.col("vec_id") % 2 == 1).collect()]
    assert one[0] == 5 and all(i % 2 for i in one)
    queries = spark.createDataFrame([(0, x[0].tolist())], "query long, vector array<double>")
    assert vectors.rerank_chain(index, 5, 8).run(queries=queries)["found"].count() == 5
    texts = lambda: spark.createDataFrame([(0, 1), (77, 2)], "vec_id long, rank int")
    assert vectors.hybrid_chain(index, texts, 3).run(queries=queries)["found"].first()["vec_id"] == 0
    where = F.col("vec_id") % 50 == 0
    best = [r["vec_id"] for r in vectors.top_k(e.where("embedding is not null"), "vec_id", "embedding", x[0].tolist(), 4, where=where).collect()]
    assert [r["vec_id"] for r in vectors.top_k_then(e.where("embedding is not null"), "vec_id", "embedding", x[0].tolist(), 4, where, whole=True).collect()] == best
    ap = vectors.average_precision(spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query int, k int, rank int"), spark.createDataFrame([(1, 10), (1, 12)], "query int, k int"), "query", "k")
    assert ap.first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_pages_by_cursor(spark):
    spec = QuerySpec.of({"table": "t", "orderBy": [{"column": "id"}]})
    rows, info = plan.connection(spec, spark.range(5), 2)
    assert [r[0] for r in rows.collect()] == [0, 1] and info["hasNextPage"] and not info["hasPreviousPage"]
    rows, info = plan.connection(spec, spark.range(5), 3, info["endCursor"])
    assert [r[0] for r in rows.collect()] == [2, 3, 4] and not info["hasNextPage"] and info["hasPreviousPage"]
    rows, info = plan.connection(spec, spark.range(5), last=2, before=plan.cursor(4))
    assert [r[0] for r in rows.collect()] == [2, 3] and info["hasNextPage"] and info["hasPreviousPage"]
    with pytest.raises(ValueError):
        plan.place("eHg6MQ==")


def test_backup_and_metadata_totals(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/a")
    table.append(spark.range(10).withColumn("k", F.lit("x")))
    table.append(spark.range(5).withColumn("k", F.lit(None).cast("string")))
    assert table.totals()["rows"] == 15 and sum(table.partitions().values()) == 15
    copy = table.backup(f"file://{tmp_path}/b", table.as_of(id=1))
    assert copy.checksum()[0] == 10 and copy.checksum() != table.checksum()
