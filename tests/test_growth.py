"""What must not grow faster than its input: no shuffles of tokens or values, and the same results."""

import glob

import pandas as pd
from pyspark.sql import functions as F

from skarn.functions.aggregates import Aggregate, summed
from skarn.operators import schema, search


def test_an_index_is_written_in_sorted_segments(spark, tmp_path):
    """One file a task, no folders of parts, so nothing is shuffled; keys that repeat are one document."""
    rows = [(i % 50, f"Red sky {'blue ' * (i % 3)}word{i}") for i in range(51)] + [(None, "red red"), (70, None)]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(3)
    index = search.TextIndex.build(docs, "id", {"text": 1.0}, f"file://{tmp_path}/index")
    files = [pd.read_parquet(f) for f in glob.glob(f"{tmp_path}/index/postings/*.parquet")]
    assert 1 <= len(files) <= 3 and all(list(f["term"]) == sorted(f["term"]) for f in files)
    about = {r["term"]: (r["df"], r["n"]) for r in index.terms().collect()}
    assert about["red"] == (50, 53) and about["word0"] == (1, 1) and index.repeats and index.n_docs == 53
    assert {r["id"] for r in index.search('"sky blue"', None).collect()} == {i % 50 for i in range(51) if i % 3} and [r["id"] for r in index.search("word50", None).collect()] == [0]


def test_a_search_shuffles_no_tokens(spark):
    docs = spark.createDataFrame([(1, "red blue sky"), (2, "red sky blue"), (3, "blue sky blue sky red grey"), (4, None), (5, "lone")], "id int, text string")
    found = search.search(docs, "id", "text", 'red OR "blue sky" -grey', None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange hashpartitioning(key" in plan and "term" not in plan and [r["id"] for r in found.collect()] == [1, 2]
    assert [r["id"] for r in search.search(docs, "id", "text", "lo* OR grey", None).collect()] == [5, 3]


def test_bm25_cuts_each_text_once(spark):
    docs = spark.createDataFrame([(1, "red Red sky"), (2, "reddish"), (3, None)], "id int, text string")
    found = search.bm25(docs, "id", "text", ["red", "sky"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 and [(r["id"], r["matched"]) for r in found.collect()] == [(1, 2)]
    assert search.bm25(docs, "id", "text", []).count() == 0


def test_percentiles_hold_no_group_in_a_task(spark):
    """Exact, for all rows and groups, ties, nulls and NaN, without an aggregate that keeps all values."""
    rows = [(None if i % 7 == 0 else i % 3, float(i * 7919 % 5000) if i % 11 else None) for i in range(20_000)] + [(9, None), (8, float("nan")), (8, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    df.createOrReplaceTempView("percentile_rows")
    given = [Aggregate("percentile", "v", f"p{i}", share=s) for i, s in enumerate([0.0, 0.5, 0.95, 0.9999, 1.0])]
    want = ", ".join(f"percentile(v, {a.share}) as {a.name}" for a in given)
    for keys, group in (([], ""), ([F.col("k")], "group by k")):
        found = summed(df, keys, [Aggregate("count", None, "n"), *given])
        assert " percentile(" not in found._jdf.queryExecution().optimizedPlan().toString().replace("[percentile(", " percentile(")
        listed = lambda d: sorted(map(repr, map(tuple, d.collect())))
        assert listed(found) == listed(spark.sql(f"select {'k, ' if keys else ''}count(*) as n, {want} from percentile_rows {group}"))
    assert summed(df.where("v is null and k = 9"), [], given).first()[0] is None


def test_shredding_asks_no_container_for_its_kind(spark):
    """schema_of_variant walks all below a container, so it stands above all generators; empty containers vanish, leaves stay."""
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":null},[],{}]},"d":"x","e":{}}'), (2, "[]"), (3, "5"), (4, "{bad"), (5, None)], "id int, doc string")
    found = schema.shred_long(docs, ["id"], "doc")
    assert sorted(map(tuple, found.collect())) == [(1, "a.b[0]", "bigint", "1"), (1, "a.b[1].c", "void", None), (1, "d", "string", "x"), (3, "", "bigint", "5")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and "schemaOfVariant" not in plan[plan.index("variant_explode") :]
