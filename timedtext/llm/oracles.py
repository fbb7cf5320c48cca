"""SQL of the training-data queries that SQL can express, as DuckDB reads it."""

from __future__ import annotations

from timedtext.llm.common import LOWER, UPPER
from timedtext.llm.decontamination import WINDOW

OP1 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score from v q join v on v.vec_id <> q.vec_id and len(v.e) = len(q.e) where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
with b as (select item_id, {_WORDS} as w from benchmark), i as (select item_id, w, least(len(w), {WINDOW}) as n from b where len(w) > 0),
g as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as gram from (select *, unnest(range(1, len(w) - n + 2)) as s from i)),
d as (select doc_id, {_WORDS} as w from documents),
p as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as s, w from d, (select distinct n from g) where len(w) >= n),
h as (select doc_id, s, p.n, item_id from (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as gram from p) p join g using (gram)),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from h) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {rank} as rank, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(q[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'k': length(v[i])}}), lambda s: s.k >= {least})) as s
from (select doc_id, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', {group}) as v, regexp_split_to_array(text, '{p}') as q from t)"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

OP4 = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
s as ({_spans('assign', 0, _ASSIGN, 2, 8)} union all {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 16)} union all {_spans('hex', 2, '[0-9a-f]+', 0, 32)}),
l as (select doc_id, count_if(kind = 'assign')::bigint as n_assign, count_if(kind = 'access')::bigint as n_access, count_if(kind = 'hex')::bigint as n_hex,
  string_agg(kind || ':' || s.a::bigint || ':' || (s.a + s.n)::bigint, ',' order by s.a, rank) as spans from s group by doc_id)
select t.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from t left join l using (doc_id)
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as html from pages), f as (select html, min(page_id) as first from p group by html),
d as (select page_id, first, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as h from p join f using (html)),
b as (select *, array_to_string(list_transform(string_split(h, ''), lambda c: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', c)]), '') as bits from d)
select page_id, payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (list_sum(list_transform(range(5), lambda k: (case when substr(bits, i * 5 + k + 1, 1) = '1' then 1 else 0 end) * (16 >> k::int))))::int, 1)), '') as payload_digest,
case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from b
"""

OP12 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id, list_dot_product(a.e, v.e)::bigint as score from v a join v on v.vec_id <> a.vec_id and len(v.e) = len(a.e) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
n as (select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score where place <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

OP13 = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from p),
t as (select lang, sum(len(w))::hugeint as n from w group by lang),
f as (select lang, d, phrase, count(*)::hugeint as f from (select lang, d, unnest(list_transform(range(1, len(w) - d + 2), lambda i: array_to_string(w[i:i + d - 1], ' '))) as phrase from w, (select unnest(range(1, 6)) as d)) group by all having count(*) >= 100),
c as (select *, string_split(phrase, ' ') as w from f where d > 1),
m as (select lang, phrase, max(f) as most from (select lang, f, unnest([array_to_string(w[1:d - 1], ' '), array_to_string(w[2:d], ' ')]) as phrase from c where d > 2) group by all),
k as (select lang, phrase, f as a, w, unnest(range(1, d)) as k, d from c left join m using (lang, phrase) where most is null or most < f),
s as (select k.lang, k.phrase, a, k, l.f as l, r.f as r, t.n, 1000 * a * t.n // (l.f * r.f) as score from k join t using (lang)
  join f l on l.lang = k.lang and l.phrase = array_to_string(k.w[1:k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(k.w[k + 1:k.d], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b) where rank <= 2000
"""

ORACLE = {"op1_kdtree": OP1, "op3_decontamination": OP3, "op4_secrets": OP4, "op6_warc": OP6, "op12_hard_negatives": OP12, "op13_collocations": OP13}
