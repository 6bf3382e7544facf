"""The shapes of a web-analytics workload, and of document collections with arrays, as queries of the engine on the supplied tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.expressions import case, fn, lit
from ..operators import sets
from ..operators.builder import Engine

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

N = {"function": "count", "alias": "n"}
TOP = [{"column": "n", "direction": "desc"}]


def agg(function: str, column: str, alias: str) -> dict:
    return {"function": function, "column": column, "alias": alias}


def test(column: str, op: str, value=None, **more) -> dict:
    return {"column": column, "op": op, "value": value, **more}


def by(*columns: str) -> list[dict]:
    return [{"column": c} for c in columns]


def web(name: str, sql: str, table: str, **given) -> None:
    """A query given as a description, and the same in SQL."""
    columns = given.pop("select", None)
    if columns:
        given["projection"] = columns
    QUERIES[name] = lambda spark, d: Engine(spark, d).run({"table": table, **given})
    ORACLES[name] = sql


web("wa_count", "select count(*) as n from lineitem", "lineitem", aggregations=[N])
web("wa_filtered_count", "select count(*) as n from events where value is distinct from 0", "events", predicates=[test("value", "ne", 0.0)], aggregations=[N])
web(
    "wa_multi_agg",
    "select round(sum(l_quantity), 1) as s, count(*) as n, round(avg(l_extendedprice), 4) as a from lineitem",
    "lineitem",
    aggregations=[agg("sum", "l_quantity", "s"), N, agg("avg", "l_extendedprice", "a")],
    finish={"s": fn("round", "s", 1), "a": fn("round", "a", 4)},
)
web("wa_avg_key", "select round(avg(l_orderkey), 4) as a from lineitem", "lineitem", aggregations=[agg("avg", "l_orderkey", "a")], finish={"a": fn("round", "a", 4)})
web("wa_distinct_int", "select count(distinct user_id) as n from events", "events", aggregations=[agg("countDistinct", "user_id", "n")])
web("wa_distinct_string", "select count(distinct source) as n from documents", "documents", aggregations=[agg("countDistinct", "source", "n")])
web("wa_min_max_date", "select min(o_orderdate) as lo, max(o_orderdate) as hi from orders", "orders", aggregations=[agg("min", "o_orderdate", "lo"), agg("max", "o_orderdate", "hi")])
web(
    "wa_group_filter",
    "select event_type, count(*) as n from events where event_type is distinct from 'view' group by event_type",
    "events",
    predicates=[test("event_type", "<>", "view")],
    groupBy=["event_type"],
    aggregations=[N],
    orderBy=[*TOP, *by("event_type")],
)
web(
    "wa_distinct_by_group",
    "select event_type, count(distinct user_id) as u from events group by event_type order by u desc, event_type limit 10",
    "events",
    groupBy=["event_type"],
    aggregations=[agg("countDistinct", "user_id", "u")],
    orderBy=[{"column": "u", "direction": "desc"}, *by("event_type")],
    limit=10,
)
web(
    "wa_group_many_aggs",
    "select l_returnflag, round(sum(l_quantity), 1) as s, count(*) as n, round(avg(l_discount), 6) as a, count(distinct l_suppkey) as u from lineitem group by l_returnflag order by n desc limit 10",
    "lineitem",
    groupBy=["l_returnflag"],
    aggregations=[agg("sum", "l_quantity", "s"), N, agg("avg", "l_discount", "a"), agg("countDistinct", "l_suppkey", "u")],
    finish={"s": fn("round", "s", 1), "a": fn("round", "a", 6)},
    orderBy=TOP,
    limit=10,
)
web(
    "wa_nonempty_group",
    "select source, count(distinct lang) as u from documents where source <> '' group by source order by u desc, source limit 10",
    "documents",
    predicates=[test("source", "ne", ""), test("source", "isNotNull")],
    groupBy=["source"],
    aggregations=[agg("countDistinct", "lang", "u")],
    orderBy=[{"column": "u", "direction": "desc"}, *by("source")],
    limit=10,
)
web(
    "wa_two_keys_distinct",
    "select source, lang, count(distinct doc_id) as u from documents where source <> '' group by source, lang order by u desc, source, lang limit 10",
    "documents",
    predicates=[test("source", "ne", ""), test("source", "isNotNull")],
    groupBy=["source", "lang"],
    aggregations=[agg("countDistinct", "doc_id", "u")],
    orderBy=[{"column": "u", "direction": "desc"}, *by("source", "lang")],
    limit=10,
)
web(
    "wa_string_group_top",
    "select p_name, count(*) as n from part where p_name <> '' group by p_name order by n desc, p_name limit 10",
    "part",
    predicates=[test("p_name", "ne", "")],
    groupBy=["p_name"],
    aggregations=[N],
    orderBy=[*TOP, *by("p_name")],
    limit=10,
)
web(
    "wa_string_distinct",
    "select p_type, count(distinct p_brand) as u from part where p_type <> '' group by p_type order by u desc, p_type limit 10",
    "part",
    predicates=[test("p_type", "ne", "")],
    groupBy=["p_type"],
    aggregations=[agg("countDistinct", "p_brand", "u")],
    orderBy=[{"column": "u", "direction": "desc"}, *by("p_type")],
    limit=10,
)
web(
    "wa_mixed_group",
    "select p_size, p_type, count(*) as n from part where p_type <> '' group by p_size, p_type order by n desc, p_size, p_type limit 10",
    "part",
    predicates=[test("p_type", "ne", "")],
    groupBy=["p_size", "p_type"],
    aggregations=[N],
    orderBy=[*TOP, *by("p_size", "p_type")],
    limit=10,
)
web(
    "wa_high_card_group",
    "select l_orderkey, count(*) as n from lineitem group by l_orderkey order by n desc, l_orderkey limit 10",
    "lineitem",
    groupBy=["l_orderkey"],
    aggregations=[N],
    orderBy=[*TOP, *by("l_orderkey")],
    limit=10,
)
web(
    "wa_two_high_card",
    "select l_partkey, l_suppkey, count(*) as n from lineitem group by all order by n desc, l_partkey, l_suppkey limit 10",
    "lineitem",
    groupBy=["l_partkey", "l_suppkey"],
    aggregations=[N],
    orderBy=[*TOP, *by("l_partkey", "l_suppkey")],
    limit=10,
)


def unordered_limit(spark, d):
    """Any ten groups: how many there are, and how many of them are as the whole table says."""
    e = Engine(spark, d)
    given = {"table": "lineitem", "groupBy": ["l_partkey", "l_suppkey"], "aggregations": [N]}
    found, whole = e.run({**given, "limit": 10}), e.run(given)
    return found.join(whole.withColumnRenamed("n", "m"), ["l_partkey", "l_suppkey"]).agg(F.count("*").alias("n"), F.count_if(F.col("n") == F.col("m")).alias("right"))


QUERIES["wa_unordered_limit"] = unordered_limit
ORACLES["wa_unordered_limit"] = "select 10::bigint as n, 10::bigint as right"
web(
    "wa_minute_group",
    "select user_id, cast(minute(ts) as integer) as m, event_type, count(*) as n from events group by all order by n desc, user_id, m, event_type limit 10",
    "events",
    compute={"m": fn("minute", "ts")},
    groupBy=["user_id", "m", "event_type"],
    aggregations=[N],
    orderBy=[*TOP, *by("user_id", "m", "event_type")],
    limit=10,
)
web("wa_point_lookup", "select event_id, user_id from events where user_id = 8", "events", predicates=[test("user_id", "eq", 8)], select=["event_id", "user_id"])
web("wa_like_count", "select count(*) as n from pages where url ilike '%example%'", "pages", predicates=[test("url", "like", "%example%")], aggregations=[N])
web(
    "wa_like_group",
    "select url, min(page_id) as first, count(*) as n from pages where url ilike '%blog%' and url <> '' group by url order by n desc, url limit 10",
    "pages",
    predicates=[test("url", "like", "%blog%"), test("url", "ne", "")],
    groupBy=["url"],
    aggregations=[agg("min", "page_id", "first"), N],
    orderBy=[*TOP, *by("url")],
    limit=10,
)
web(
    "wa_not_like",
    "select p_type, min(p_name) as first, min(p_brand) as brand, count(*) as n, count(distinct p_brand) as u from part"
    " where p_name ilike '%a%' and p_brand not ilike '%#1%' and p_type <> '' group by p_type order by n desc, p_type limit 10",
    "part",
    predicates=[test("p_name", "like", "%a%"), test("p_brand", "like", "%#1%", **{"not": True}), test("p_type", "ne", "")],
    groupBy=["p_type"],
    aggregations=[agg("min", "p_name", "first"), agg("min", "p_brand", "brand"), N, agg("countDistinct", "p_brand", "u")],
    orderBy=[*TOP, *by("p_type")],
    limit=10,
)
web(
    "wa_wide_top",
    "select * from orders where o_orderpriority ilike '%HIGH%' order by o_orderdate, o_orderkey limit 10",
    "orders",
    predicates=[test("o_orderpriority", "like", "%HIGH%")],
    orderBy=by("o_orderdate", "o_orderkey"),
    limit=10,
)
web(
    "wa_sort_time",
    "select o_orderkey from orders where o_orderpriority <> '' order by o_orderdate, o_orderkey limit 10",
    "orders",
    predicates=[test("o_orderpriority", "ne", "")],
    orderBy=by("o_orderdate", "o_orderkey"),
    limit=10,
    select=["o_orderkey"],
)
web("wa_sort_string", "select p_name, p_partkey from part order by p_name, p_partkey limit 10", "part", orderBy=by("p_name", "p_partkey"), limit=10, select=["p_name", "p_partkey"])
web(
    "wa_sort_two_keys",
    "select o_orderdate, o_orderpriority, o_orderkey from orders order by o_orderdate, o_orderpriority, o_orderkey limit 10",
    "orders",
    orderBy=by("o_orderdate", "o_orderpriority", "o_orderkey"),
    limit=10,
    select=["o_orderdate", "o_orderpriority", "o_orderkey"],
)
web(
    "wa_having_length",
    "select source, round(avg(length(text)), 4) as l, count(*) as n from documents where text is distinct from '' group by source having count(*) > 20 order by l desc, source limit 25",
    "documents",
    compute={"size": fn("length", "text")},
    predicates=[test("text", "ne", ""), test("n", "gt", 20)],
    groupBy=["source"],
    aggregations=[agg("avg", "size", "l"), N],
    finish={"l": fn("round", "l", 4)},
    orderBy=[{"column": "l", "direction": "desc"}, *by("source")],
    limit=25,
)
web(
    "wa_regex_host",
    r"select regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') as host, round(avg(length(url)), 4) as l, count(*) as n, min(url) as first from pages"
    " where url <> '' group by 1 having count(*) > 1 order by l desc, host limit 25",
    "pages",
    compute={"host": fn("replace", "url", r"^https?://(?:www\.)?([^/]+)/.*$", "$1"), "size": fn("length", "url")},
    predicates=[test("url", "ne", ""), test("url", "isNotNull"), test("n", "gt", 1)],
    groupBy=["host"],
    aggregations=[agg("avg", "size", "l"), N, agg("min", "url", "first")],
    finish={"l": fn("round", "l", 4)},
    orderBy=[{"column": "l", "direction": "desc"}, *by("host")],
    limit=25,
)
web(
    "wa_wide_sums",
    "select " + ", ".join(f"cast(sum(l_linenumber + {k}) as bigint) as s{k}" for k in range(90)) + " from lineitem",
    "lineitem",
    compute={f"l{k}": fn("add", "l_linenumber", lit(k)) for k in range(90)},
    aggregations=[agg("sum", f"l{k}", f"s{k}") for k in range(90)],
)
SUMS = [N, agg("sum", "l_discount", "s"), agg("avg", "l_quantity", "a")]
ROUNDED = {"s": fn("round", "s", 2), "a": fn("round", "a", 6)}
for _name, _keys, _where in [
    ("wa_group_sum_avg", ["l_suppkey", "l_returnflag"], True),
    ("wa_group_unique_filtered", ["l_orderkey", "l_suppkey"], True),
    ("wa_group_unique", ["l_orderkey", "l_linenumber"], False),
]:
    web(
        _name,
        f"select {', '.join(_keys)}, count(*) as n, round(sum(l_discount), 2) as s, round(avg(l_quantity), 6) as a from lineitem"
        f"{" where l_linestatus <> ''" if _where else ''} group by all order by n desc, {', '.join(_keys)} limit 10",
        "lineitem",
        predicates=[test("l_linestatus", "ne", "")] if _where else [],
        groupBy=_keys,
        aggregations=SUMS,
        finish=ROUNDED,
        orderBy=[*TOP, *by(*_keys)],
        limit=10,
    )
web(
    "wa_url_group",
    "select url, count(*) as n from pages group by url order by n desc, url limit 10",
    "pages",
    groupBy=["url"],
    aggregations=[N],
    orderBy=[*TOP, *by("url")],
    limit=10,
)
web(
    "wa_group_literal",
    "select 1 as one, l_partkey, count(*) as n from lineitem group by 1, l_partkey order by n desc, l_partkey limit 10",
    "lineitem",
    compute={"one": lit(1)},
    groupBy=["one", "l_partkey"],
    aggregations=[N],
    orderBy=[*TOP, *by("l_partkey")],
    limit=10,
)
web(
    "wa_group_expressions",
    "select l_suppkey, l_suppkey - 1 as a, l_suppkey - 2 as b, l_suppkey - 3 as c, count(*) as n from lineitem group by all order by n desc, l_suppkey limit 10",
    "lineitem",
    compute={name: fn("subtract", "l_suppkey", lit(k)) for name, k in (("a", 1), ("b", 2), ("c", 3))},
    groupBy=["l_suppkey", "a", "b", "c"],
    aggregations=[N],
    orderBy=[*TOP, *by("l_suppkey")],
    limit=10,
)
DATES = [test("o_orderdate", "gte", datetime(1995, 1, 1)), test("o_orderdate", "lte", datetime(1996, 12, 31))]
BETWEEN = "o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31'"
web(
    "wa_date_range_top",
    f"select o_custkey, count(*) as n from orders where {BETWEEN} and o_orderstatus <> 'P' group by o_custkey order by n desc, o_custkey limit 10",
    "orders",
    predicates=[*DATES, test("o_orderstatus", "ne", "P")],
    groupBy=["o_custkey"],
    aggregations=[N],
    orderBy=[*TOP, *by("o_custkey")],
    limit=10,
)
web(
    "wa_date_range_title",
    f"select o_orderpriority, count(*) as n from orders where {BETWEEN} and o_orderstatus = 'F' and o_orderpriority <> '' group by o_orderpriority order by n desc, o_orderpriority limit 10",
    "orders",
    predicates=[*DATES, test("o_orderstatus", "eq", "F"), test("o_orderpriority", "ne", "")],
    groupBy=["o_orderpriority"],
    aggregations=[N],
    orderBy=[*TOP, *by("o_orderpriority")],
    limit=10,
)
web(
    "wa_offset",
    "select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey order by n desc, o_custkey limit 10 offset 100",
    "orders",
    predicates=[test("o_orderstatus", "eq", "F")],
    groupBy=["o_custkey"],
    aggregations=[N],
    orderBy=[*TOP, *by("o_custkey")],
    limit=10,
    offset=100,
)
web(
    "wa_case_group",
    "select l_suppkey, case when l_returnflag = 'R' and l_linestatus = 'F' then 'returned' else '' end as src, count(*) as n from lineitem group by all order by n desc, l_suppkey, src limit 10 offset 20",
    "lineitem",
    compute={"src": case(([test("l_returnflag", "eq", "R"), test("l_linestatus", "eq", "F")], lit("returned")), otherwise=lit(""))},
    groupBy=["l_suppkey", "src"],
    aggregations=[N],
    orderBy=[*TOP, *by("l_suppkey", "src")],
    limit=10,
    offset=20,
)
web(
    "wa_in_list",
    "select o_custkey, o_orderdate, count(*) as n from orders where o_custkey in (1, 5, 8, 13, 21) and o_orderstatus = 'F' group by all order by n desc, o_custkey, o_orderdate limit 10 offset 2",
    "orders",
    predicates=[test("o_custkey", "in", [1, 5, 8, 13, 21]), test("o_orderstatus", "eq", "F")],
    groupBy=["o_custkey", "o_orderdate"],
    aggregations=[N],
    orderBy=[*TOP, *by("o_custkey", "o_orderdate")],
    limit=10,
    offset=2,
)
web(
    "wa_window_sizes",
    "select l_quantity, l_linenumber, count(*) as n from lineitem where l_suppkey = 3 group by all order by n desc, l_quantity, l_linenumber limit 10 offset 10",
    "lineitem",
    predicates=[test("l_suppkey", "eq", 3)],
    groupBy=["l_quantity", "l_linenumber"],
    aggregations=[N],
    orderBy=[*TOP, *by("l_quantity", "l_linenumber")],
    limit=10,
    offset=10,
)
web(
    "wa_minute_series",
    "select date_trunc('minute', ts) as m, count(*) as n from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-08' group by 1 order by m limit 10 offset 20",
    "events",
    compute={"m": fn("truncate_time", "ts", "minute")},
    predicates=[test("ts", "gte", datetime(2024, 1, 1)), test("ts", "lt", datetime(2024, 1, 8)), test("ts", "isNotNull")],
    groupBy=["m"],
    aggregations=[N],
    orderBy=by("m"),
    limit=10,
    offset=20,
)

# collections with arrays
QUERIES["mv_genre_filter"] = lambda spark, d: (
    Engine(spark, d)
    .table("lineitem")
    .compute(o_orderkey="l_orderkey")
    .group_by("o_orderkey")
    .aggregate("collect", "l_returnflag", "flags", distinct=True)
    .finish(n=fn("size", "flags"), has=fn("array_contains", "flags", lit("R")))
    .to_df()
    .where("has")
    .select("o_orderkey", "n")
)
ORACLES["mv_genre_filter"] = (
    "select o_orderkey, cast(len(flags) as integer) as n from (select l_orderkey as o_orderkey, list(distinct l_returnflag) as flags from lineitem group by l_orderkey) where list_contains(flags, 'R')"
)


def decade_rollup(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.floor(F.year("o_orderdate") / 5) * 5).alias("half_decade"), "o_totalprice", "o_orderkey")
    out = sets.rollup_with_top(rows, ["half_decade"], "o_totalprice", [F.desc("o_totalprice"), F.desc("o_orderkey")], "o_orderkey", 3)
    return out.select("half_decade", "n", F.round("mean", 4).alias("mean"), "top")


QUERIES["mv_decade_rollup"] = decade_rollup
ORACLES["mv_decade_rollup"] = (
    "select cast(floor(year(o_orderdate) / 5) * 5 as bigint) as half_decade, count(*) as n, round(avg(o_totalprice), 4) as mean,"
    " list(o_orderkey order by o_totalprice desc, o_orderkey desc)[1:3] as top from orders group by 1"
)


def explode_stats(spark, d):
    e = Engine(spark, d)
    flags = e.table("lineitem").group_by("l_orderkey").aggregate("collect", "l_returnflag", "flags", distinct=True).to_df()
    held = e.scan("orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"))
    found = sets.exploded_statistics(held, "flags", "o_totalprice", "flag")
    return found.select("flag", F.col("n").alias("orders"), F.round("mean", 4).alias("mean"), "low", "high")


QUERIES["mv_explode_stats"] = explode_stats
ORACLES["mv_explode_stats"] = (
    "select f as flag, count(*) as orders, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as low, max(o_totalprice) as high"
    " from (select distinct l_orderkey, l_returnflag as f from lineitem) join orders on o_orderkey = l_orderkey group by f"
)
web(
    "mv_weighted_score",
    "select p_partkey, round(p_retailprice * log10(p_size + 1), 6) as score from part order by score desc, p_partkey limit 20",
    "part",
    compute={"score": fn("round", fn("multiply", "p_retailprice", fn("log10", fn("add", "p_size", lit(1)))), 6)},
    orderBy=[{"column": "score", "direction": "desc"}, *by("p_partkey")],
    limit=20,
    select=["p_partkey", "score"],
)
web(
    "mv_any_every",
    "select l_orderkey, bool_or(l_discount > 0.08) as any_high, bool_and(l_quantity >= 5) as all_five from lineitem group by l_orderkey",
    "lineitem",
    compute={"high": case(([test("l_discount", "gt", 0.08)], lit(True)), otherwise=lit(False)), "five": case(([test("l_quantity", "gte", 5.0)], lit(True)), otherwise=lit(False))},
    groupBy=["l_orderkey"],
    aggregations=[agg("max", "high", "any_high"), agg("min", "five", "all_five")],
)


def embedded_lookup(spark, d):
    """Of each customer's embedded orders, the keys of those above a price: no row is exploded."""
    e = Engine(spark, d)
    e.relate("orders", "orders", "o_custkey", "customer", "c_custkey")
    held = e.related("orders", embed=["o_orderkey", "o_totalprice"])
    return sets.embedded(held, "orders", lambda o: o["o_totalprice"] > 300_000, lambda o: o["o_orderkey"], "large").select("c_custkey", F.sort_array("large").alias("large"))


QUERIES["embedded_lookup"] = embedded_lookup
ORACLES["embedded_lookup"] = (
    "select c_custkey, coalesce(list(o_orderkey order by o_orderkey) filter (o_totalprice > 300000), []) as large from customer left join orders on o_custkey = c_custkey group by c_custkey"
)
web(
    "dict_by_language",
    "select lang, count(*) as n, round(avg(n_chars), 4) as mean from documents group by lang",
    "documents",
    groupBy=["lang"],
    aggregations=[N, agg("avg", "n_chars", "mean")],
    finish={"mean": fn("round", "mean", 4)},
)
web(
    "dict_prefix",
    "select doc_id, lang from documents where starts_with(text, 'The') and lang in ('en', 'de')",
    "documents",
    compute={"fits": fn("starts_with", "text", lit("The"))},
    predicates=[test("fits", "eq", True), test("lang", "in", ["en", "de"])],
    select=["doc_id", "lang"],
)
web(
    "dict_text_search",
    "select doc_id from documents where contains(lower(text), 'stupid')",
    "documents",
    compute={"fits": fn("contains", fn("lower", "text"), lit("stupid"))},
    predicates=[test("fits", "eq", True)],
    select=["doc_id"],
)
web(
    "turns_per_conversation",
    "select conv_id, count(*) as turns, max(turn) as last, cast(count(*) filter (role = 'user') as bigint) as asked from conversations group by conv_id",
    "conversations",
    groupBy=["conv_id"],
    aggregations=[{"function": "count", "alias": "turns"}, agg("max", "turn", "last"), {"function": "count", "alias": "asked", "filter": test("role", "eq", "user")}],
)
