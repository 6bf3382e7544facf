"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: Exact: shingles of each document, links by common shingles, groups by following links.
OP4 = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as materialized (
    select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as s
    from w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) u(i) where len(w) > 0
), n as materialized (select doc_id, count(*) as n from sh group by doc_id
), links as materialized (
    select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as common from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by all) p
    join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * common >= 80 * (x.n + y.n - common)
), reach as (
    select doc_id, doc_id as other from w
    union
    select reach.doc_id, links.b from reach join links on links.a = reach.other
)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id, w.doc_id = min(other) as kept
from w join reach using (doc_id) left join n using (doc_id) group by w.doc_id
"""

OP7 = """
with p as (
    select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
    select page_id, octet_length(payload) as n, sha256(payload) as digest from p
), f as (
    select digest, min(page_id) as first_id from d where n >= 100 group by digest
)
select d.page_id, d.n::bigint as payload_bytes, d.digest as payload_digest,
       case when f.first_id is not null and f.first_id is distinct from d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id is distinct from d.page_id then f.first_id end as refers_to
from d left join f on d.n >= 100 and d.digest = f.digest
"""

#: Words are split alike; windows of a document are cut for each length that an item's windows have.
OP9 = r"""
with dw as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), iw as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), iwin as (
    select distinct item_id, size, array_to_string(w[j:j + size - 1], ' ') as win
    from (select item_id, w, least(8, len(w)) as size from iw where len(w) > 0) t, unnest(range(1, len(w) - size + 2)) u(j)
), sizes as (select distinct size from iwin
), dwin as (
    select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as win
    from dw, sizes, unnest(range(1, len(w) - size + 2)) u(i) where len(w) >= size
), hits as (
    select distinct doc_id, item_id, dwin.size, i from dwin join iwin on dwin.size = iwin.size and dwin.win = iwin.win
), words as (
    select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + size)) as x from hits) t group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
    from (select distinct doc_id, item_id::varchar as item_id from hits) t group by doc_id
)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""

ORACLES = {"op4_near_duplicates": OP4, "op7_warc": OP7, "op9_decontamination": OP9}
