"""Queries of this package and their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from twinloom.llm.canonical_dups import p5_found, p5_representatives
from twinloom.llm.contraction import p1_found, p1_group_sizes
from twinloom.llm.cross_split import p2_coverage, p2_found, p2_report
from twinloom.llm.leak_search import p7_found, p7_items
from twinloom.llm.mojibake import p8_found, p8_restored
from twinloom.llm.near_dup import p3_found, p3_group_sizes
from twinloom.llm.packing import p6_fill, p6_packed
from twinloom.llm.split_assign import p4_shares, p4_splits

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_group_sizes, p2_found, p2_report, p2_coverage, p3_found, p3_group_sizes, p4_splits, p4_shares, p5_found, p5_representatives, p6_packed, p6_fill, p7_found, p7_items, p8_found, p8_restored)
}


def _digest(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '^\\s*(sha256:)?\\s*|\\s+$', '', 'g'), '')"


def _origin(c: str) -> str:
    trimmed = f"regexp_replace(replace(lower({c}), '\\', '/'), '^\\s+|\\s+$', '', 'g')"
    return f"nullif(regexp_replace(regexp_replace({trimmed}, '/+', '/', 'g'), '^(\\./)+', ''), '')"


_GROUPS = f"""
members as (
  select distinct language as l, {_origin("human_origin_id")} as o, unnest([{_digest("human_code_sha256")}, {_digest("candidate_code_sha256")}]) as d
  from feature_bank where language is not null
), m as (select * from members where o is not null and d is not null),
reach(l, o, g) as (
  select distinct l, o, o from m
  union
  select b.l, b.o, r.g from reach r join m a on a.l = r.l and a.o = r.o join m b on b.l = a.l and b.d = a.d
), grouped as (select l as language, min(g) as group_id, o as human_origin_id from reach group by l, o having count(*) > 1)
"""

_LEAKED = f"""
t as (
  select side, llm_source, pair_id, language, {_digest("human_code_sha256")} as hd, {_digest("candidate_code_sha256")} as cd,
    {_origin("human_origin_id")} as ho, {_origin("candidate_origin_id")} as co
  from pair_spec
), seen_d as (select hd as d from t where side = 'train' and hd is not null union select cd from t where side = 'train' and cd is not null),
seen_o as (
  select language as l, ho as o from t where side = 'train' and language is not null and ho is not null
  union select language, co from t where side = 'train' and language is not null and co is not null
), flags as (
  select side, llm_source, pair_id, (hd in (from seen_d)) as a, (cd in (from seen_d)) as b,
    ((language, ho) in (select (l, o) from seen_o)) as c, ((language, co) in (select (l, o) from seen_o)) as e
  from t where side in ('valid', 'test')
), leaked as (select *, coalesce(a, false)::int + coalesce(b, false)::int + coalesce(c, false)::int + coalesce(e, false)::int as n from flags where a or b or c or e)
"""


def _plain(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


_COPIES = f"""
src as (
  select record_id, human_src as h, llm_src as m from task1
  union all
  select record_id, case json_type(j, '$.human_src') when 'VARCHAR' then j ->> '$.human_src' end, case json_type(j, '$.llm_src') when 'VARCHAR' then j ->> '$.llm_src' end
  from (select record_id, case when json_valid(line) then line::json end as j from task1_raw) where json_type(j) = 'OBJECT'
), forms as (select distinct record_id, {_plain("h")} as h, {_plain("m")} as m from src),
sets as (select record_id, min(record_id) over (partition by h, m) as keep_id, count(*) over (partition by h, m) as n_copies from forms where h <> '' and m <> '')
"""

_NEAR = f"""
forms as (select distinct record_id, {_plain("human_src")} as h, {_plain("llm_src")} as m from task1),
recs as (select * from forms where h <> '' and m <> ''),
texts as (select side, t, row_number() over (order by side, t) as i from (select distinct 0 as side, h as t from recs union select distinct 1, m from recs)),
grams as (select distinct side, i, unnest(list_transform(range(1, length(t) - 6), lambda k: substr(t, k, 8))) as g from texts where length(t) >= 8),
sizes as (select side, i, count(*) as n from grams group by 1, 2),
shared as (select a.side, a.i as x, b.i as y, count(*) as k from grams a join grams b on a.side = b.side and a.g = b.g and a.i < b.i group by 1, 2, 3),
alike as (select s.side, x, y from shared s join sizes a on a.i = x join sizes b on b.i = y where 10 * k >= 6 * (a.n + b.n - k)),
near as (select side, x, y from alike union all select side, y, x from alike union all select side, i, i from sizes),
r as (select record_id, h.i as hi, m.i as mi from recs join texts h on h.side = 0 and h.t = recs.h join texts m on m.side = 1 and m.t = recs.m),
edges as (select distinct a.record_id as a, b.record_id as b from r a join near h on h.side = 0 and h.x = a.hi join r b on b.hi = h.y join near m on m.side = 1 and m.x = a.mi and m.y = b.mi where a.record_id <> b.record_id),
reach(i, g) as (select distinct a, a from edges union select e.b, reach.g from reach join edges e on e.a = reach.i),
grouped as (select min(g) as group_id, i as record_id from reach group by i)
"""

_LEAKS = r"""
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
q as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
dw as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as x from d where len(w) >= 13),
qw as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as x from q where len(w) >= 13),
leaks as (select distinct doc_id, item_id from dw join qw using (x))
"""

ORACLE = {
    "p1_found": f"with recursive {_GROUPS} select language, group_id, human_origin_id from grouped",
    "p1_group_sizes": f"with recursive {_GROUPS}, s as (select language, group_id, count(*) as origins from grouped group by 1, 2) select language, origins, count(*) as n_groups from s group by 1, 2",
    "p2_found": f"with {_LEAKED} select side, llm_source, pair_id from leaked",
    "p2_report": f"with {_LEAKED} select side, llm_source, count(*) as n_rows from leaked group by 1, 2",
    "p2_coverage": f"with {_LEAKED} select side, pair_id, n::bigint as covered_tokens, 4::bigint as n_tokens from leaked",
    "p3_found": f"with recursive {_NEAR} select group_id, record_id from grouped",
    "p3_group_sizes": f"with recursive {_NEAR}, s as (select group_id, count(*) as records from grouped group by 1) select records, count(*) as n_groups from s group by 1",
    "p7_found": f"with {_LEAKS} select doc_id, item_id from leaks",
    "p7_items": f"with {_LEAKS} select item_id, count(*) as n_documents from leaks group by 1",
    "p5_found": f"with {_COPIES} select keep_id, record_id from sets where record_id <> keep_id",
    "p5_representatives": f"with {_COPIES} select keep_id, n_copies from sets where record_id = keep_id",
}
