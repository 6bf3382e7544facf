"""Scans, predicates, projections, aggregates, sorting and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import range_filter, tree_filter
from ..operators.builder import Engine
from ..operators.policy import Policies
from ..operators.sets import top_per_group

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Orders with nulls in some places, for the null rules: the same in both engines.
NULLED = "(select o_orderkey, o_custkey, o_orderdate, case when o_orderkey % 7 = 0 then null else o_orderstatus end as status, case when o_orderkey % 5 = 0 then null else o_totalprice end as price, o_orderpriority from orders)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def nulled(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), "o_orderpriority")


def engine(spark, d) -> Engine:
    e = Engine(spark, d)
    e.register("nulled", nulled(spark, d))
    e.register("props", spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.from_json("props", "k long").alias("props")))
    return e


def spec(name: str, sql: str, **given):
    query(name, sql)(lambda spark, d: engine(spark, d).run(given))


@query("flagship_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all order by all")
def flagship(spark, d):
    q = engine(spark, d)
    q.register("line", q.scan("lineitem").withColumn("disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    out = q.table("line").where("l_shipdate", "lte", datetime(1998, 9, 2)).group_by("l_returnflag", "l_linestatus").aggregate("sum", "l_quantity", "sum_qty").aggregate("sum", "l_extendedprice", "sum_price").aggregate("sum", "disc_price", "sum_disc").aggregate("avg", "l_quantity", "avg_qty").aggregate("avg", "l_discount", "avg_disc").count("n").order_by("l_returnflag").order_by("l_linestatus").to_df()
    return out.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("sum_price", 2).alias("sum_price"), F.round("sum_disc", 2).alias("sum_disc"), F.round("avg_qty", 6).alias("avg_qty"), F.round("avg_disc", 6).alias("avg_disc"), "n")


spec("scan_project", "select l_orderkey, l_linenumber, l_quantity from lineitem", table="lineitem", projection=["l_orderkey", "l_linenumber", "l_quantity"])
spec("project_alias", "select o_orderkey as id, o_totalprice as total from orders", table="orders", projection={"columns": ["o_orderkey", "o_totalprice"], "aliases": {"o_orderkey": "id", "o_totalprice": "total"}})
spec("project_missing_null", "select o_orderkey, cast(null as varchar) as absent from orders", table="orders", projection=["o_orderkey", "absent"], missing="null")
query("project_nested", """select event_id, cast(json_extract(props, '$.k') as bigint) as "props.k" from events""")(lambda spark, d: engine(spark, d).run({"table": "props", "projection": ["event_id", "props.k"]}))
#: Each comparison with the rows that it keeps; null counts as less than everything and equal to null.
for _name, _p, _sql in [
    ("eq", {"column": "status", "op": "eq", "value": "F"}, "status is not distinct from 'F'"),
    ("eq_null", {"column": "status", "op": "eq", "value": None}, "status is null"),
    ("ne", {"column": "status", "op": "!=", "value": "F"}, "status is distinct from 'F'"),
    ("gt", {"column": "price", "op": ">", "value": 200000.0}, "price > 200000"),
    ("gte", {"column": "price", "op": "ge", "value": 200000.0}, "price >= 200000"),
    ("lt", {"column": "price", "op": "<", "value": 50000.0}, "price is null or price < 50000"),
    ("lte", {"column": "price", "op": "lte", "value": 50000.0}, "price is null or price <= 50000"),
    ("gt_null", {"column": "price", "op": "gt", "value": None}, "price is not null"),
    ("gte_null", {"column": "price", "op": "gte", "value": None}, "true"),
    ("lt_null", {"column": "price", "op": "lt", "value": None}, "false"),
    ("lte_null", {"column": "price", "op": "lte", "value": None}, "price is null"),
    ("between", {"column": "price", "op": "between", "value": [1000.0, 60000.0]}, "price between 1000 and 60000"),
    ("between_bounds", {"column": "price", "op": "between", "lowerBound": 1000.0, "upperBound": 60000.0}, "price between 1000 and 60000"),
    ("in", {"column": "status", "op": "in", "values": ["F", "O"]}, "status in ('F', 'O')"),
    ("in_null", {"column": "status", "op": "in", "values": ["F", None]}, "status = 'F' or status is null"),
    ("not_in", {"column": "status", "op": "not in", "values": ["F"]}, "status <> 'F' or status is null"),
    ("like", {"column": "o_orderpriority", "op": "like", "value": "%-h_gh"}, "o_orderpriority ilike '%-h_gh'"),
    ("is_null", {"column": "price", "op": "is null"}, "price is null"),
    ("is_not_null", {"column": "price", "op": "isNotNull"}, "price is not null"),
    ("not", {"column": "price", "op": "gt", "value": 100000.0, "not": True}, "not coalesce(price > 100000, false)"),
]:
    spec(f"filter_{_name}", f"select o_orderkey, status, price from {NULLED} where {_sql}", table="nulled", predicates=[_p], projection=["o_orderkey", "status", "price"])
spec("filter_and", f"select o_orderkey, status, price from {NULLED} where (price is null or price < 90000) and status is distinct from 'F' and o_custkey >= 100", table="nulled", predicates=[{"column": "price", "op": "lt", "value": 90000.0}, {"column": "status", "op": "ne", "value": "F"}, {"column": "o_custkey", "op": "gte", "value": 100}], projection=["o_orderkey", "status", "price"])
query("filter_stream_mode", f"select o_orderkey, price from {NULLED} where price < 50000")(lambda spark, d: (lambda n: n.where(range_filter(n, {"price": {"$lt": 50000.0}})).select("o_orderkey", "price"))(nulled(spark, d)))
query("mongo_filter", f"select o_orderkey, status, price from {NULLED} where status in ('F', 'P') and price > 1000 and price <= 150000 and o_orderpriority is distinct from '5-LOW'")(lambda spark, d: (lambda n: n.where(range_filter(n, {"status": {"$in": ["F", "P"]}, "price": {"$gt": 1000.0, "$lte": 150000.0}, "o_orderpriority": {"$ne": "5-LOW"}})).select("o_orderkey", "status", "price"))(nulled(spark, d)))
query("graphql_filter", f"select o_orderkey from {NULLED} where (status is not distinct from 'F' or coalesce(price > 400000, false)) and not (o_custkey >= 500 and o_orderpriority ilike '1%')")(lambda spark, d: (lambda n: n.where(tree_filter(n, {"OR": [{"status": "F"}, {"price_gt": 400000.0}], "NOT": {"o_custkey_gte": 500, "o_orderpriority_like": "1%"}})).select("o_orderkey"))(nulled(spark, d)))


@query("rls_filter", "select o_orderkey, o_custkey from orders where o_custkey = 7 or o_orderstatus = 'F'")
def rls(spark, d):
    rules = Policies()
    rules.add("orders", "select", lambda user: F.col("o_custkey") == user["id"])
    rules.add("orders", "select", lambda user: F.col("o_orderstatus") == "F")
    return rules.visible("orders", spark.read.parquet(f"{d}/orders.parquet"), {"id": 7}).select("o_orderkey", "o_custkey")


for _fn, _sql in [
    ("count", "count(price)"), ("countDistinct", "count(distinct price)"), ("sum", "coalesce(round(sum(price), 1), 0)"), ("sumDistinct", "coalesce(round(sum(distinct price), 1), 0)"), ("avg", "round(avg(price), 4)"), ("avgDistinct", "round(avg(distinct price), 4)"),
    ("min", "min(price)"), ("max", "max(price)"), ("stddev", "case when count(price) >= 2 then round(stddev_pop(price), 3) end"), ("variance", "case when count(price) >= 2 then round(var_pop(price) / 1e6, 2) end"),
    ("first", "arg_min(price, o_orderkey) filter (price is not null)"), ("last", "arg_max(price, o_orderkey) filter (price is not null)"),
]:

    def _aggregate(spark, d, fn=_fn):
        places = {"sum": 1, "sumDistinct": 1, "avg": 4, "avgDistinct": 4, "stddev": 3, "variance": 2}
        out = engine(spark, d).table("nulled").group_by("status").aggregate(fn, "price", "v", order="o_orderkey" if fn in ("first", "last") else None).to_df()
        value = F.col("v") / 1e6 if fn == "variance" else F.col("v")
        return out.select("status", (F.round(value, places[fn]) if fn in places else value).alias("v"))

    query(f"agg_{_fn}", f"select status, {_sql} as v from {NULLED} group by status")(_aggregate)


@query("agg_global_empty", "select cast(0 as bigint) as n, cast(0 as double) as total, cast(null as double) as mean, cast(null as double) as low")
def empty(spark, d):
    return engine(spark, d).table("orders").where("o_orderkey", "lt", -1).count("n").aggregate("sum", "o_totalprice", "total").aggregate("avg", "o_totalprice", "mean").aggregate("min", "o_totalprice", "low").to_df()


@query("agg_filter_distinct", "select l_returnflag, round(sum(l_quantity) filter (l_discount >= 0.05), 2) as q, count(distinct l_suppkey) as s from lineitem group by l_returnflag")
def agg_filter(spark, d):
    given = {"table": "lineitem", "groupBy": ["l_returnflag"], "aggregations": [{"function": "sum", "column": "l_quantity", "alias": "q", "filter": {"column": "l_discount", "op": "gte", "value": 0.05}}, {"function": "count", "column": "l_suppkey", "alias": "s", "distinct": True}]}
    return engine(spark, d).run(given).select("l_returnflag", F.round("q", 2).alias("q"), "s")


spec("group_multi_key", f"select status, o_orderpriority, count(*) as n, count(price) as p from {NULLED} group by all", table="nulled", groupBy=["status", "o_orderpriority"], aggregations=[{"function": "count", "alias": "n"}, {"function": "count", "column": "price", "alias": "p"}])
spec("group_having", "select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey having count(*) > 12 order by n desc, o_custkey limit 50", table="orders", groupBy=["o_custkey"], aggregations=[{"function": "count", "alias": "n"}, {"function": "max", "column": "o_totalprice", "alias": "top"}], predicates=[{"column": "n", "op": "gt", "value": 12}], orderBy=[{"column": "n", "direction": "desc"}, {"column": "o_custkey"}], limit=50)
query("agg_percentiles", "select round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.95), 4) as p95 from orders")(lambda spark, d: engine(spark, d).table("orders").aggregate("percentile", "o_totalprice", "p50", share=0.5).aggregate("percentile", "o_totalprice", "p95", share=0.95).to_df().select(F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")))
query("agg_collect", "select n_regionkey, list(n_nationkey order by n_nationkey) as keys from nation group by n_regionkey")(lambda spark, d: engine(spark, d).table("nation").group_by("n_regionkey").aggregate("collect", "n_nationkey", "keys").to_df())


@query("partial_final_agg", "select l_suppkey, count(*) as n, round(sum(l_quantity), 2) as q, round(avg(l_quantity), 6) as mean, min(l_shipdate) as first from lineitem group by l_suppkey")
def partial_final(spark, d):
    """Partial sums by (supplier, flag), then their totals."""
    part = engine(spark, d).table("lineitem").group_by("l_suppkey", "l_returnflag").count("c").aggregate("sum", "l_quantity", "s").aggregate("min", "l_shipdate", "f").to_df()
    return part.groupBy("l_suppkey").agg(F.sum("c").alias("n"), F.round(F.sum("s"), 2).alias("q"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean"), F.min("f").alias("first"))


@query("block_statistics", "select l_returnflag, min(l_quantity) as lo, max(l_quantity) as hi, count(*) filter (l_quantity is null) as nulls, count(distinct l_quantity) as d from lineitem group by all")
def block_statistics(spark, d):
    return engine(spark, d).scan("lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count_if(F.col("l_quantity").isNull()).alias("nulls"), F.count_distinct("l_quantity").alias("d"))


for _name, _direction, _nulls, _sql in [("asc", "asc", None, "asc nulls last"), ("desc", "desc", None, "desc nulls first"), ("asc_first", "asc", "first", "asc nulls first"), ("desc_last", "desc", "last", "desc nulls last")]:
    spec(f"sort_nulls_{_name}", f"select o_orderkey, price from {NULLED} order by price {_sql}, o_orderkey limit 4000", table="nulled", orderBy=[{"column": "price", "direction": _direction, "nulls": _nulls}, {"column": "o_orderkey"}], limit=4000, projection=["o_orderkey", "price"])
spec("limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 1000", table="orders", orderBy=[{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}], limit=25, offset=1000, projection=["o_orderkey", "o_totalprice"])
spec("limit_zero", "select o_orderkey from orders where false", table="orders", limit=0, projection=["o_orderkey"])
spec("sort_by_unprojected", "select o_orderkey from orders order by o_totalprice, o_orderkey limit 10", table="orders", orderBy=[{"column": "o_totalprice"}, {"column": "o_orderkey"}], limit=10, projection=["o_orderkey"])
query("page", "select o_orderkey, o_custkey from orders order by o_orderkey limit 20 offset 60")(lambda spark, d: engine(spark, d).table("orders").select("o_orderkey", "o_custkey").order_by("o_orderkey").page(4, 20).to_df())
query("topk_per_group", "select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as rank from orders) where rank <= 3")(lambda spark, d: top_per_group(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank"))
query("grouping_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")(lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
