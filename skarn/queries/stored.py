"""Versioned tables, documents, full text and vectors over the supplied tables, with what each writes in a folder of its own."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import ABOVE_0, ABOVE_1, HAS_VOWEL, JUST_1, SHORT, STEP_2, STEP_3, STEP_4, english_stem
from ..operators import changelog, schema, search, sets, vectors
from ..operators.builder import Engine
from ..operators.lakehouse import Table, changed
from ..operators.policy import Policies

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


def place(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="skarn-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/skarn/{name}-{uuid.uuid4().hex}"


# versioned tables


def orders(spark, d) -> Table:
    """A versioned table of orders: three appends."""
    table = Table(spark, place(spark, "orders"))
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for k in range(3):
        table.append(o.where(F.col("o_orderkey") % 3 == k))
    return table


@query("snapshot_asof", "select o_orderkey, o_totalprice from orders where o_orderkey % 3 < 2")
def snapshot_asof(spark, d):
    table = orders(spark, d)
    return table.read(table.as_of(id=2)).select("o_orderkey", "o_totalprice")


@query("snapshot_asof_engine", "select o_orderstatus, count(*) as n from orders where o_orderkey % 3 < 2 and o_totalprice >= 1000 group by o_orderstatus")
def snapshot_asof_engine(spark, d):
    e = Engine(spark)
    e.register("versions", orders(spark, d))
    return e.table("versions").as_of_snapshot(2).where("o_totalprice", "gte", 1000.0).group_by("o_orderstatus").count("n").to_df()


@query("prune_stats", "select o_orderkey from orders where o_orderkey <= 500")
def prune_stats(spark, d):
    return orders(spark, d).read(where=[("o_orderkey", "lte", 500)]).where("o_orderkey <= 500").select("o_orderkey")


@query("prune_nan", "select o_orderkey from orders where o_orderkey % 50 = 0 or o_totalprice >= 300000")
def prune_nan(spark, d):
    """In Spark, NaN is above all numbers: a file that holds one may match, whatever its other values."""
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("v"))
    table = Table(spark, place(spark, "nan"))
    for part in (F.col("v") < 100_000, F.isnan("v"), (F.col("v") >= 100_000) & ~F.isnan("v")):
        table.append(o.where(part))
    return table.read(where=[("v", "gte", 300_000.0)]).where("v >= 300000").select("o_orderkey")


@query("prune_date", "select o_orderkey, cast(o_orderdate as date) as day from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-03-01'")
def prune_date(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    table = Table(spark, place(spark, "days"))
    table.append(o.where("day < date '1996-01-01'"))
    table.append(o.where("day >= date '1996-01-01'"))
    wanted = [("day", "gte", date(1996, 1, 1)), ("day", "lt", date(1996, 3, 1))]
    return table.read(where=wanted).where("day >= date '1996-01-01' and day < date '1996-03-01'").select("o_orderkey", "day")


def by_priority(spark, d, times: int = 1) -> Table:
    """Orders in partitions of their priority, which is null for some."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"))
    table = Table(spark, place(spark, "priorities"))
    for k in range(times):
        table.append(o.where(F.col("o_orderkey") % times == k), ["priority"])
    return table


@query("prune_partition", "select o_orderkey, o_orderpriority as priority from orders where o_orderkey % 11 <> 0 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def prune_partition(spark, d):
    return by_priority(spark, d).read(where=[("priority", "in", ["1-URGENT", "2-HIGH"])]).where("priority in ('1-URGENT', '2-HIGH')").select("o_orderkey", "priority")


@query("partition_totals", "select case when o_orderkey % 11 <> 0 then o_orderpriority end as priority, count(*) as n from orders group by 1")
def partition_totals(spark, d):
    """From metadata alone."""
    return spark.createDataFrame([(dict(k)["priority"], n) for k, n in by_priority(spark, d).partitions().items()], "priority string, n long")


@query("metadata_range", "select min(o_orderkey) as low, max(o_orderkey) as high, count(*) as n from orders")
def metadata_range(spark, d):
    table = orders(spark, d)
    low, high, _ = table.range_of("o_orderkey")
    return spark.createDataFrame([(low, high, table.totals()["rows"])], "low long, high long, n long")


@query("snapshot_compact", "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 1) as total from orders group by o_orderstatus")
def snapshot_compact(spark, d):
    table = orders(spark, d)
    table.compact()
    return table.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("snapshot_compact_partitioned", "select case when o_orderkey % 11 <> 0 then o_orderpriority end as priority, count(*) as n, round(sum(o_totalprice), 1) as total, true as smaller from orders group by 1")
def snapshot_compact_partitioned(spark, d):
    """Partitions and rows stay; files become fewer."""
    table = by_priority(spark, d, 3)
    before = table.totals()["files"]
    table.compact()
    smaller = table.totals()["files"] < before and not table.problems()
    return table.read().groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total")).withColumn("smaller", F.lit(smaller))


@query("snapshot_expire", "select 2::bigint as gone, 1::bigint as kept, cast(count(*) as bigint) as n from orders where o_orderkey % 3 <> 1 or o_orderkey < 100")
def snapshot_expire(spark, d):
    table = orders(spark, d)
    table.delete((F.col("o_orderkey") % 3 == 1) & (F.col("o_orderkey") >= 100))
    gone, _ = table.expire(keep_last=2)
    return table.read().agg(F.count("*").alias("n")).select(F.lit(len(gone)).cast("long").alias("gone"), F.lit(len(table.snapshots()) - 1).cast("long").alias("kept"), "n")


@query(
    "snapshot_diff",
    "select count(*) filter (o_orderkey % 3 = 0) as unchanged, count(*) filter (o_orderkey % 3 <> 0) as added, count(*) filter (o_orderkey % 3 <> 0) as removed_going_back from orders",
)
def snapshot_diff(spark, d):
    """Rows of the files that two snapshots share and do not share, both ways."""
    table = orders(spark, d)
    old, new = table.as_of(id=1), table.as_of(id=3)
    rows = {f.path: f.rows for f in new.files}
    count = lambda paths: sum(rows[p] for p in paths)
    found, back = changed(old, new), changed(new, old)
    return spark.createDataFrame([(count(found["unchanged"]), count(found["added"]), count(back["removed"]))], "unchanged long, added long, removed_going_back long")


@query(
    "transaction_commit",
    "select o_orderkey, case when o_orderkey % 5 = 0 then 0 else o_totalprice end as o_totalprice, o_orderstatus from orders where o_orderkey % 7 <> 0",
)
def transaction_commit(spark, d):
    """Two changes and one taken back become one snapshot."""
    table = orders(spark, d)
    change = table.transaction().update(F.col("o_orderkey") % 5 == 0, {"o_totalprice": 0.0}).savepoint("kept")
    change.delete(F.col("o_orderstatus") == "F").rollback_to("kept").delete(F.col("o_orderkey") % 7 == 0)
    change.commit()
    return table.read()


@query("widened_append", "select o_orderkey::double as k, o_orderstatus as s, null::varchar as more from orders union all select c_acctbal, c_mktsegment, c_name from customer")
def widened_append(spark, d):
    """Types are promoted and columns added, in the table as well as in its old files."""
    table = Table(spark, place(spark, "widened"))
    table.append(t(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("k"), F.col("o_orderstatus").alias("s")))
    table.append(t(spark, d, "customer").select(F.col("c_acctbal").alias("k"), F.col("c_mktsegment").alias("s"), F.col("c_name").alias("more")))
    return table.read()


@query("rls_engine", "select o_orderkey, o_custkey, o_orderstatus from orders where (o_custkey = 7 or o_orderstatus = 'F') and o_totalprice >= 1000")
def rls_engine(spark, d):
    rules = Policies()
    rules.add("orders", "select", lambda user: F.col("o_custkey") == user["id"])
    rules.add("orders", "select", lambda user: F.col("o_orderstatus") == "F")
    return Engine(spark, d, rules).as_user({"id": 7}).table("orders").where("o_totalprice", "gte", 1000.0).select("o_orderkey", "o_custkey", "o_orderstatus").to_df()


query("filter_like_number", "select o_orderkey from orders")(lambda spark, d: Engine(spark, d).table("orders").where_not("o_orderkey", "like", "1%").select("o_orderkey").to_df())


@query("path_index", "select o_orderkey, o_custkey as second from orders where o_custkey < 100")
def path_index(spark, d):
    e = Engine(spark, d)
    e.register("pairs", e.scan("orders").select("o_orderkey", F.array("o_orderkey", "o_custkey").alias("pair")))
    return e.table("pairs").where("pair[1]", "lt", 100).select("o_orderkey", "pair[1]").rename(**{"pair[1]": "second"}).to_df()


@query(
    "lww_map",
    "select user_id, list(event_type order by event_type) as kinds, list(value order by event_type) as latest from"
    " (select user_id, event_type, arg_max(value, (ts, event_id)) as value from events where value is not null group by all) group by user_id",
)
def lww_map(spark, d):
    found = changelog.last_writer_map(t(spark, d, "events").where("value is not null"), ["user_id"], "event_type", "value", "ts", "event_id")
    return found.select("user_id", F.map_keys("entries").alias("kinds"), F.map_values("entries").alias("latest"))


# documents


def text_documents(spark, d) -> DataFrame:
    deep = "".join(f'{{"l{k}":' for k in range(1, 15))
    doc = F.concat(F.lit(deep), F.lit("[{\"k\":"), F.col("event_id").cast("string"), F.lit('},"x",null]'), F.lit("}" * 14))
    return t(spark, d, "events").select("event_id", doc.alias("doc"))


_PROPS = "select event_id, key as path, cast(json_extract(props, '$.' || key) as varchar) as value from events, unnest(json_keys(props)) k(key)"
query("shred_long", _PROPS)(lambda spark, d: schema.shred_long(t(spark, d, "events"), ["event_id"], "props").select("event_id", "path", "value"))
_DEEP = ".".join(f"l{k}" for k in range(1, 15))
query(
    "shred_deep",
    f"select event_id, '{_DEEP}[' || i || ']' || case i when 0 then '.k' else '' end as path, case i when 0 then 'bigint' when 1 then 'string' else 'void' end as kind,"
    " case i when 0 then event_id::varchar when 1 then 'x' end as value from events, (values (0), (1), (2)) v(i)",
)(lambda spark, d: schema.shred_long(text_documents(spark, d), ["event_id"], "doc"))
query("shred_columns", f"select event_id, '{_DEEP}[1]' as path, 'x' as value from events")(
    lambda spark, d: schema.shred_long(text_documents(spark, d), ["event_id"], "doc", columns=[f"{_DEEP}[1]"]).select("event_id", "path", "value")
)
query("infer_schema", "select key as path, count(*) as n, cast(0 as bigint) as nulls, 'bigint' as kind from events, unnest(json_keys(props)) k(key) group by key")(
    lambda spark, d: schema.path_types(schema.shred_long(t(spark, d, "events"), ["event_id"], "props"))
)
query("unshred", "select event_id, '{\"k\":' || json_extract(props, '$.k') || '}' as document from events")(
    lambda spark, d: schema.unshred(schema.shred_long(t(spark, d, "events"), ["event_id"], "props"), ["event_id"])
)


@query(
    "unshred_nested",
    """select event_id, '{"a":{"b":[' || event_id || ',true,{"c":null}],"z":1.5},"name":"' || event_type || '"}' as document from events""",
)
def unshred_nested(spark, d):
    """Objects in arrays, flags, nulls and fractions come back as they were."""
    doc = F.concat(F.lit('{"a": {"b": ['), F.col("event_id").cast("string"), F.lit(', true, {"c": null}], "z": 1.5}, "name": "'), F.col("event_type"), F.lit('"}'))
    docs = t(spark, d, "events").select("event_id", doc.alias("doc"))
    return schema.unshred(schema.shred_long(docs, ["event_id"], "doc"), ["event_id"])


# full text

TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zA-Z0-9À-ɏ]+'), lambda x: x <> '')"
#: Tokens by document, documents of each term, and the weight of each (document, term): what the queries below start from.
_WEIGHTS = f"""with w as (select doc_id, {TOKENS} as words from documents), s as (select count(*) as nd, avg(len(words)) as ml from w),
    e as (select doc_id, len(words) as len, unnest(words) as term from w), f as (select doc_id, len, term, count(*) as tf from e group by all),
    df as (select term, count(*) as df from f group by term),
    b as (select doc_id, term, ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / ml)) as weight from f join df using (term), s)"""


def rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 6).alias("score"))


query(
    "search_ranked",
    _WEIGHTS
    + """, m as (select b.doc_id, sum(weight) as score from b join w using (doc_id) where term in ('stupid', 'of', 'the')
      and contains(' ' || array_to_string(words, ' ') || ' ', ' of the ') and list_contains(words, 'stupid') and not list_contains(words, 'loser') group by b.doc_id)
    select doc_id, round(score, 6) as score from m order by round(score, 9) desc, doc_id limit 10""",
)(lambda spark, d: rounded(search.search(t(spark, d, "documents"), "doc_id", "text", 'stupid "of the" -loser')))
query(
    "search_excluded",
    _WEIGHTS + " select doc_id, round(weight, 6) as score from b join w using (doc_id) where term = 'stupid' and not list_contains(words, 'loser')",
)(lambda spark, d: rounded(search.search(t(spark, d, "documents"), "doc_id", "text", "stupid -loser", None)))
query(
    "search_and_prefix",
    _WEIGHTS
    + """ select doc_id, round(sum(weight), 6) as score from b where term = 'stupid' or starts_with(term, 'lo') group by doc_id
    having bool_or(term = 'stupid') and bool_or(starts_with(term, 'lo'))""",
)(lambda spark, d: rounded(search.search(t(spark, d, "documents"), "doc_id", "text", "stupid lo*", None)))
query(
    "search_or_phrase",
    _WEIGHTS
    + """ select doc_id, round(sum(weight), 6) as score from b join w using (doc_id) where term = 'stupid' or term in ('of', 'the')
      and contains(' ' || array_to_string(words, ' ') || ' ', ' of the ') group by doc_id""",
)(lambda spark, d: rounded(search.search(t(spark, d, "documents"), "doc_id", "text", 'stupid OR "of the"', None)))


@query(
    "index_weighted",
    f"""with x as (select doc_id, 'text' as field, {TOKENS} as words from documents union all select doc_id, 'source', {TOKENS.replace('text', 'source')} from documents),
    l as (select doc_id, sum(len(words)) as len from x group by doc_id), s as (select (select count(*) from documents) as nd, (select sum(len) from l) / (select count(*) from documents) as ml),
    f as (select doc_id, field, term, count(*) as tf from (select doc_id, field, unnest(words) as term from x) group by all), df as (select term, count(distinct doc_id) as df from f group by term),
    b as (select doc_id, field, term, ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / ml)) * case field when 'source' then 3 else 1 end as weight
      from f join df using (term) join l using (doc_id), s where term = 'stupid' or starts_with(term, 'lo'))
    select doc_id, round(sum(weight), 6) as score from b group by doc_id having bool_or(term = 'stupid') and bool_or(starts_with(term, 'lo'))""",
)
def index_weighted(spark, d):
    """A stored index over two weighted fields; every term of a prefix counts."""
    index = search.TextIndex.build(t(spark, d, "documents"), "doc_id", {"text": 1.0, "source": 3.0}, place(spark, "index"))
    return rounded(index.search("stupid lo*", None))


@query("index_phrase", f"select doc_id from (select doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' as t from documents) where contains(t, ' of the ') and not contains(t, ' stupid ')")
def index_phrase(spark, d):
    index = search.TextIndex.build(t(spark, d, "documents"), "doc_id", {"text": 1.0}, place(spark, "index"))
    return index.search('"of the" NOT stupid', None).select("doc_id")


def _porter_sql() -> str:
    """Porter's steps over the distinct tokens, in the other engine's words."""
    listed = lambda x: "|".join(x)
    swap = lambda s, table: f"case {s} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + " end"
    has, cut = lambda p, c: f"regexp_matches({c}, '{p}')", lambda c, n: f"left({c}, len({c}) - {n})"
    ending = lambda c, x: (f"regexp_extract({c}, '^(.+?)({listed(x)})$', 1)", f"regexp_extract({c}, '^(.+?)({listed(x)})$', 2)")
    s1, e1 = ending("w", ["eed", "ed", "ing"])
    whole = f"case when {has('(at|bl|iz)$', 's')} then s || 'e' when len(s) > 1 and right(s, 1) = left(right(s, 2), 1) and {has('[^aeiouylsz]$', 's')} then {cut('s', 1)} when {has(SHORT, 's')} then s || 'e' else s end"
    s2, e2 = ending("w", STEP_2)
    s3, e3 = ending("w", STEP_3)
    s4, e4 = ending("w", STEP_4)
    return f"""with d as (select distinct unnest({TOKENS}) as term from documents),
    a as (select term, case when term like '%sses' or term like '%ies' then {cut('term', 2)} when term like '%s' and term not like '%ss' then {cut('term', 1)} else term end as w from d),
    b0 as (select term, w, {s1} as s, {e1} as e from a),
    b as (select term, case when e = 'eed' then case when {has(ABOVE_0, 's')} then s || 'ee' else w end when e <> '' and {has(HAS_VOWEL, 's')} then {whole} else w end as w from b0),
    c as (select term, case when w like '%y' and {has(HAS_VOWEL, cut('w', 1))} then {cut('w', 1)} || 'i' else w end as w from b),
    e0 as (select term, w, {s2} as s, {e2} as e from c), e1 as (select term, case when e <> '' and {has(ABOVE_0, 's')} then s || {swap('e', STEP_2)} else w end as w from e0),
    f0 as (select term, w, {s3} as s, {e3} as e from e1), f1 as (select term, case when e <> '' and {has(ABOVE_0, 's')} then s || {swap('e', STEP_3)} else w end as w from f0),
    g0 as (select term, w, {s4} as s, {e4} as e from f1), g1 as (select term, case when e <> '' and {has(ABOVE_1, 's')} and (e <> 'ion' or {has('[st]$', 's')}) then s else w end as w from g0),
    h as (select term, case when w like '%e' and ({has(ABOVE_1, cut('w', 1))} or {has(JUST_1, cut('w', 1))} and not {has(SHORT, cut('w', 1))}) then {cut('w', 1)} else w end as w from g1),
    i as (select term, case when w like '%ll' and {has(ABOVE_1, 'w')} then {cut('w', 1)} else w end as w from h)
    select term, case when len(term) < 3 then term else w end as stem from i"""


query("stemmed_terms", _porter_sql())(lambda spark, d: search.term_statistics(t(spark, d, "documents"), "text").select("term", english_stem(F.col("term")).alias("stem")))
query(
    "highlight",
    r"select doc_id, regexp_replace(text, '(?i)(^|[^a-zA-Z0-9À-ɏ])(stupid|loser)($|[^a-zA-Z0-9À-ɏ])', '\1<em>\2</em>\3', 'g') as marked from documents where doc_id in"
    r" (select doc_id from documents where regexp_matches(text, '(?i)(^|[^a-zA-Z0-9À-ɏ])(stupid|loser)($|[^a-zA-Z0-9À-ɏ])') and not regexp_matches(text, '(?i)(stupid|loser)[^a-zA-Z0-9À-ɏ](stupid|loser)'))",
)(
    lambda spark, d: t(spark, d, "documents")
    .where(F.col("text").rlike(r"(?i)(?<![a-zA-Z0-9À-ɏ])(stupid|loser)(?![a-zA-Z0-9À-ɏ])") & ~F.col("text").rlike(r"(?i)(stupid|loser)[^a-zA-Z0-9À-ɏ](stupid|loser)"))
    .select("doc_id", search.highlighted(F.col("text"), ["stupid", "loser"]).alias("marked"))
)


# vectors


def first_vector(spark, d) -> list[float]:
    return list(t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_RANKS = ", ".join(
    f"{name} as (select vec_id, row_number() over (order by {sql}, vec_id) as r from embeddings, q)"
    for name, sql in (("a", "1 - list_cosine_similarity(embedding::double[], q)"), ("b", "list_distance(embedding::double[], q)"))
)


@query(
    "rrf",
    f"with q as (select embedding::double[] as q from embeddings where vec_id = 0), {_RANKS}, f as (select vec_id, r from a where r <= 50 union all select vec_id, r from b where r <= 50)"
    " select vec_id, round(sum(1 / (60 + r)), 9) as score from f group by vec_id order by sum(1 / (60 + r)) desc, vec_id limit 20",
)
def rrf(spark, d):
    e, q = t(spark, d, "embeddings"), first_vector(spark, d)
    near = [vectors.top_k(e, "vec_id", "embedding", q, 50, m).withColumn("one", F.lit(1)) for m in ("cosine", "l2sq")]
    ranked = [sets.top_per_group(x, ["one"], [F.col("distance"), F.col("vec_id")], 50).select("vec_id", "rank") for x in near]
    return vectors.fused(ranked, "vec_id").orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 9).alias("score"))


LISTS, COPIES, PROBES = 64, 3, 16


def clustered(spark, d):
    """The index, by lists in a folder, and the stated query set."""
    e = t(spark, d, "embeddings")
    asked = {r["vec_id"]: list(r["embedding"]) for r in e.where("vec_id % 100 = 0").select("vec_id", "embedding").collect()}
    return vectors.ClusterIndex.build(e, "vec_id", "embedding", place(spark, "vectors"), LISTS, COPIES), asked


@query("cluster_search", None)
def cluster_search(spark, d):
    """A quarter of the lists, ten of the best hundred by code for each query."""
    index, asked = clustered(spark, d)
    return index.search_batch(asked, 10, probes=PROBES, rerank=100).select("query", "vec_id", "rank")


@query("cluster_search_recall", None)
def cluster_search_recall(spark, d):
    """For each query of the stated set, recall and average precision of clustered search at a quarter of the lists, against exact search."""
    index, asked = clustered(spark, d)
    exact = vectors.batch_top_k(t(spark, d, "embeddings"), "vec_id", "embedding", asked, 10, "l2sq").select("query", "vec_id")
    found = index.search_batch(asked, 10, probes=PROBES).select("query", "vec_id", "rank")
    ap = vectors.average_precision(found, exact, "query", "vec_id")
    hit = exact.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left").groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return hit.join(ap, "query")
