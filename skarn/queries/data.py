"""Set operators, joins, scalars, schemas, change logs, versioned tables, text and vector search."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import changelog, chains, schema, search, sets, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def old_new(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 <> 1")


for _part, _sql in [("removed", "o_orderkey % 10 = 1"), ("added", "o_orderkey % 10 = 0"), ("unchanged", "o_orderkey % 10 not in (0, 1)")]:
    query(f"diff_{_part}", f"select o_orderkey, o_orderstatus from orders where {_sql}")(lambda spark, d, part=_part: sets.difference(*old_new(spark, d), ["o_orderkey"])[part])
query("orphans", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")(lambda spark, d: t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"))
query("row_fetch_by_ids", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")(lambda spark, d: t(spark, d, "orders").join(t(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice"))
query("denormalise", "select c_custkey, coalesce(list(o_orderkey order by o_orderkey) filter (o_orderkey is not null), []) as orders from customer left join orders on c_custkey = o_custkey group by c_custkey")(lambda spark, d: sets.denormalised(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), "o_custkey", "c_custkey", "orders", ["o_orderkey"]).select("c_custkey", F.transform("orders", lambda x: x["o_orderkey"]).alias("orders")))
query("union_all", "select n_name as name from nation union all select r_name from region")(lambda spark, d: chains.merged([t(spark, d, "nation").select(F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_name").alias("name"))]))
query("distinct_keep_first", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1")(lambda spark, d: sets.distinct_first(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type"))
query("append_evolved", "select n_nationkey as key, n_name as name, cast(null as double) as balance from nation union all select c_custkey, null, c_acctbal from customer")(lambda spark, d: sets.append_evolved(t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))))
query("intersect_except", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O' except select c_custkey from customer where c_mktsegment = 'MACHINERY'")(lambda spark, d: (lambda o: o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey")).subtract(t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")))(t(spark, d, "orders")))
query("take_while", "select event_id, ts from events where (ts, event_id) < (select (ts, event_id) from events where user_id = 3 order by ts, event_id limit 1)")(lambda spark, d: sets.take_while(t(spark, d, "events"), F.col("user_id") != 3, [F.col("ts"), F.col("event_id")]).select("event_id", "ts"))

query("xform_parts", "select event_id, cast(year(ts) as integer) as y, cast(month(ts) as integer) as m, cast(day(ts) as integer) as dd, cast(hour(ts) as integer) as h from events")(lambda spark, d: t(spark, d, "events").select("event_id", S.date_part(F.col("ts"), "year").alias("y"), S.date_part(F.col("ts"), "month").alias("m"), S.date_part(F.col("ts"), "day").alias("dd"), S.date_part(F.col("ts"), "hour").alias("h")))
_HASH = "list_reduce(list_prepend(0::bigint, list_transform(regexp_extract_all({c}, '(?s).'), lambda x: ascii(x)::bigint)), lambda h, u: (h * 31 + u) % 4294967296)"
query("xform_bucket", f"select c_custkey, cast(abs(case when h >= 2147483648 then h - 4294967296 else h end) % 16 as integer) as bucket from (select c_custkey, {_HASH.format(c='c_name')} as h from customer)")(lambda spark, d: t(spark, d, "customer").select("c_custkey", S.bucket(F.col("c_name"), 16).alias("bucket")))
query("xform_truncate", "select o_orderkey, cast(floor(o_orderkey / 100) * 100 as bigint) as w, substr(o_orderpriority, 1, 3) as p from orders")(lambda spark, d: t(spark, d, "orders").select("o_orderkey", S.truncate(F.col("o_orderkey"), 100).cast("long").alias("w"), S.truncate(F.col("o_orderpriority"), 3, True).alias("p")))
query("partition_paths", "select 'year=' || year(o_orderdate) || '/status=' || o_orderstatus as path, count(*) as n from orders group by all")(lambda spark, d: t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).select(S.partition_path(["year", "status"]).alias("path")).groupBy("path").agg(F.count("*").alias("n")))
query("coerce_numbers", "select o_orderkey, try_cast(regexp_extract(o_orderpriority, '^[+-]?[0-9]+') as integer) as n from orders")(lambda spark, d: t(spark, d, "orders").select("o_orderkey", S.coerce(F.col("o_orderpriority"), "int").alias("n")))
query("bands", "select case when o_totalprice < 50000 then 'low' when o_totalprice < 200000 then 'mid' else 'high' end as band, count(*) as n, floor(avg(o_totalprice) * 100 + 0.5) / 100 as mean from orders group by band")(lambda spark, d: t(spark, d, "orders").withColumn("band", S.banded(F.col("o_totalprice"), [(50000, "low"), (200000, "mid")], "high")).groupBy("band").agg(F.count("*").alias("n"), S.rounded(F.avg("o_totalprice")).alias("mean")))
query("checksums", "select c_custkey, levenshtein(c_mktsegment, 'BUILDINGS') as edits, md5(c_name) as digest from customer")(lambda spark, d: t(spark, d, "customer").select("c_custkey", F.levenshtein(F.col("c_mktsegment"), F.lit("BUILDINGS")).cast("long").alias("edits"), F.md5(F.col("c_name").cast("binary")).alias("digest")))

@query("validate_documents", "select sum(case when bad then 0 else 1 end)::bigint as valid, sum(case when bad then 1 else 0 end)::bigint as invalid from (select o_totalprice > 400000 or o_totalprice < 1000 or o_orderstatus not in ('F', 'O') as bad from orders)")
def validate(spark, d):
    rules = schema.DocumentSchema({"o_orderkey": schema.Rule(required=True, kind="bigint"), "o_totalprice": schema.Rule(min=1000, max=400000), "o_orderstatus": schema.Rule(enum=("F", "O"))}, mode="evolve")
    errors = F.size(rules.errors(o := t(spark, d, "orders")))
    return o.agg(F.count_if(errors == 0).alias("valid"), F.count_if(errors > 0).alias("invalid"))


query("latest_per_key", "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1 and event_type <> 'error'")(lambda spark, d: changelog.latest(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "error").select("user_id", "event_id", "event_type", "value"))
query("cursor_per_source", "select event_type, min(event_id) as min_lsn, max(event_id) as max_lsn, count(*) as n from events group by event_type")(lambda spark, d: changelog.cursors(t(spark, d, "events"), "event_type", "event_id"))
query("changes_beyond_cursor", "select event_id, event_type from events where event_id > 5000 or event_type <> 'click'")(lambda spark, d: changelog.beyond(t(spark, d, "events"), spark.createDataFrame([("click", 5000)], "event_type string, max_lsn long"), "event_type", "event_id").select("event_id", "event_type"))
query("dedup_changes", "select event_id, user_id from (select event_id, user_id, ts - lag(ts) over (partition by user_id, event_type order by ts) as gap from events) where gap is null or gap > interval 60 second")(lambda spark, d: changelog.deduplicated(t(spark, d, "events"), ["user_id", "event_type"], "ts", 60).select("event_id", "user_id"))
query("lww_merge", "select user_id, arg_max(value, (ts, event_id)) as value from events group by user_id")(lambda spark, d: changelog.last_writer(t(spark, d, "events"), ["user_id"], "value", "ts", "event_id"))
query("gcounter", "select user_id, cast(sum(n) as bigint) as total from (select user_id, event_type, max(event_id) as n from events group by all) group by user_id")(lambda spark, d: changelog.grow_counter(t(spark, d, "events"), ["user_id"], "event_type", "event_id"))
query("pncounter", "select user_id, cast(sum(u) - sum(w) as bigint) as total from (select user_id, event_type, max(event_id) as u, max(event_id % 100) as w from events group by all) group by user_id")(lambda spark, d: changelog.up_down_counter(t(spark, d, "events").withColumn("down", F.col("event_id") % 100), ["user_id"], "event_type", "event_id", "down"))


@query("conflicts_last_wins", "select l.user_id, case when r.ts >= l.ts then r.value else l.value end as value from (select user_id, max(ts) as ts, arg_max(value, (ts, event_id)) as value from events where event_type = 'click' group by user_id) l join (select user_id, max(ts) as ts, arg_max(value, (ts, event_id)) as value from events where event_type = 'view' group by user_id) r using (user_id)")
def conflicts(spark, d):
    e = t(spark, d, "events")
    side = lambda kind, node: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value")).withColumn("clock", F.create_map(F.lit(node), F.lit(1)))
    return changelog.resolved(changelog.conflicts(side("click", "a"), side("view", "b"), ["user_id"], "clock"), ["value"], "last").select("user_id", "value")


@query("apply_changes", "select o_orderkey, case when o_orderkey % 3 = 1 then 'U' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 3 <> 2")
def apply_changes(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    log = o.where("o_orderkey % 3 > 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.explode(F.array(F.lit(1), F.lit(2))).alias("lsn")).withColumn("op", F.when((F.col("o_orderkey") % 3 == 2) & (F.col("lsn") == 2), "DELETE").otherwise("UPDATE"))
    return changelog.applied(o, log, ["o_orderkey"], ["lsn"], "op")


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9À-ɏ]+')"
query("tokenise", f"select doc_id, len({_TOK})::integer as n, len(list_distinct({_TOK}))::integer as u from documents")(lambda spark, d: t(spark, d, "documents").select("doc_id", F.size(search.tokens(F.col("text"))).alias("n"), F.size(F.array_distinct(search.tokens(F.col("text")))).alias("u")))
query("term_stats", f"select term, count(*) as n, count(distinct doc_id) as df from (select doc_id, unnest({_TOK}) as term from documents) group by term")(lambda spark, d: search.term_statistics(t(spark, d, "documents"), "text"))
_BM25 = f"with w as (select doc_id, {_TOK} as words from documents), s as (select count(*) as nd, avg(len(words)) as ml from w), h as (select doc_id, len(words) as len, q.term, len(list_filter(words, lambda x: x = q.term)) as tf from w, (values ('thing'), ('ering'), ('stupid')) q(term)), f as (select term, count(*) as df from h where tf > 0 group by term) select doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / ml))), 6) as score from h join f using (term), s where tf > 0 group by doc_id"
query("bm25_scores", _BM25)(lambda spark, d: search.bm25(t(spark, d, "documents"), "doc_id", "text", ["thing", "ering", "stupid"]).select("doc_id", F.round("score", 6).alias("score")))
query("prefix_terms", f"select term, count(*) as n from (select unnest({_TOK}) as term from documents) where starts_with(term, 'stup') group by term")(lambda spark, d: search.prefix_terms(search.term_statistics(t(spark, d, "documents"), "text"), "stup").select("term", "n"))
query("fuzzy_terms", f"select distinct term, levenshtein(term, 'stupid') as edits from (select unnest({_TOK}) as term from documents) where levenshtein(term, 'stupid') <= 2")(lambda spark, d: search.near_terms(search.term_statistics(t(spark, d, "documents"), "text"), "stupid").select("term", F.col("edits").cast("long").alias("edits")))
query("phrase", f"select doc_id from documents where contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ')")(lambda spark, d: t(spark, d, "documents").where(search.holds_phrase(F.col("text"), ["of", "the"])).select("doc_id"))
query("facets", "select lang as value, count(*) as n from documents where contains(lower(text), 'stupid') group by lang")(lambda spark, d: search.facets(t(spark, d, "documents").where(F.lower("text").contains("stupid")), "lang"))
query("wordcount", "select word, count(*) as n from (select unnest(string_split_regex(lower(text), '\\s+')) as word from documents) where word <> '' group by word")(lambda spark, d: chains.word_count(t(spark, d, "documents"), "text"))


def _first_vector(spark, d) -> list[float]:
    return list(t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"
for _metric, _sql in [("l2sq", "power(list_distance(embedding::double[], q), 2)"), ("cosine", "1 - list_cosine_similarity(embedding::double[], q)"), ("dot", "-list_inner_product(embedding::double[], q)"), ("manhattan", "list_sum(list_transform(list_zip(embedding::double[], q), lambda x: abs(x[1] - x[2])))")]:
    query(f"{_metric}_topk", f"select vec_id, round({_sql}, 5) as distance from embeddings, {_Q} order by {_sql}, vec_id limit 10")(lambda spark, d, m=_metric: vectors.top_k(t(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 10, m).select("vec_id", F.round("distance", 5).alias("distance")))
query("hybrid_pre", f"select vec_id, round(1 - list_cosine_similarity(embedding::double[], q), 5) as distance from embeddings, {_Q} where label = 1 order by 1 - list_cosine_similarity(embedding::double[], q), vec_id limit 5")(lambda spark, d: vectors.top_k(t(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 5, where=F.col("label") == 1).select("vec_id", F.round("distance", 5).alias("distance")))
query("hybrid_post", f"select vec_id, round(distance, 5) as distance from (select vec_id, label, 1 - list_cosine_similarity(embedding::double[], q) as distance from embeddings, {_Q} order by distance, vec_id limit 60) where label = 1 order by distance, vec_id limit 20")(lambda spark, d: vectors.top_k_then(t(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 20, F.col("label") == 1).select("vec_id", F.round("distance", 5).alias("distance")))


@query("batch_knn", "select a.vec_id as query, b.vec_id, cast(rank as integer) as rank from (select a.vec_id as q, b.vec_id as v, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 100 = 0) r join embeddings a on a.vec_id = q join embeddings b on b.vec_id = v where rank <= 5")
def batch_knn(spark, d):
    e = t(spark, d, "embeddings")
    asked = {r["vec_id"]: list(r["embedding"]) for r in e.where("vec_id % 100 = 0").collect()}  # the stated query set
    return vectors.batch_top_k(e, "vec_id", "embedding", asked, 5, "l2sq").select("query", "vec_id", "rank")


query("normalise", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x / n)), 5) as total from (select vec_id, embedding, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings)")(lambda spark, d: t(spark, d, "embeddings").select("vec_id", S.normalised(F.col("embedding")).alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total")))


query("pipeline_etl", "select o_orderpriority, count(*) as n, round(sum(o_totalprice * 1.1), 1) as gross from orders where o_totalprice between 1000 and 300000 group by all")(lambda spark, d: chains.pipeline(t(spark, d, "orders"), [lambda x: x.withColumn("gross", F.col("o_totalprice") * 1.1)], F.col("o_totalprice").between(1000, 300000), [lambda x: x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("gross"), 1).alias("gross"))])[0])
