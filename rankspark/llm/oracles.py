"""DuckDB twins of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""with b as (select item_id, {_WORDS.format("text")} as w from benchmark where text is not null),
bi as (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g from bi),
d as materialized (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
di as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n),
h as materialized (select doc_id, i, di.n, item_id from di join bw on di.n = bw.n and bw.g = array_to_string(w[i : i + di.n - 1], ' ')),
p as (select doc_id, count(distinct k)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as k from h) group by 1),
t as (select doc_id, count(*)::bigint as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, item_id::varchar as s from h) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join p on p.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""

NEAR_DUPLICATES = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from w where len(w) > 0),
s as materialized (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as g from i),
n as materialized (select doc_id, count(*)::bigint as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
b as materialized (select x, y from e union all select y, x from e),
r as (select x as a, y as z from b union select r.a, b.y from r join b on r.z = b.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.z, d.doc_id)) as component_id, d.doc_id <= coalesce(m.z, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(z) as z from r group by 1) m on m.a = d.doc_id"""

FILL_IN_MIDDLE = """with h as (select row_number() over () as r, doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as s from documents),
u as (select r, doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as u, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(s, k, 8))::bigint) as h from h),
c as (select *, len(u)::bigint as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(u[1 : a], ''), '') as pre, coalesce(array_to_string(u[a + 1 : b], ''), '') as mid, coalesce(array_to_string(u[b + 1 :], ''), '') as suf from c),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end as o from p)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(o) as output_sha256, sha256(case when form = 'plain' then o else pre || mid || suf end) as restored_sha256 from o"""

#: crc32 bit by bit: SQL has no such function.
_CRC32 = "xor(4294967295, list_reduce(range(len({w})), lambda a, i: list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), xor(a, ('0x' || {w}[i + 1])::bigint)), 4294967295))"

IMPORTANCE_RESAMPLING = f"""with d as materialized (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as materialized (select unnest({_WORDS.format("coalesce(text, '')")}) as g from benchmark),
dw as materialized (select r, unnest(w) as g from d),
v as (select g, regexp_extract_all(hex(encode(g)), '..') as x from (select g from dw union select g from b)),
k as materialized (select g, {_CRC32.format(w="x")} % 10000 as bucket from v),
s as (select bucket, count(*) as s from dw join k using (g) group by 1),
t as (select bucket, count(*) as t from b join k using (g) group by 1),
gains as materialized (select s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + 10000)::double / ((s + 1)::double * ((select count(*) from b) + 10000)::double)))::bigint as gain from s left join t using (bucket)),
m as (select r, sum(gain)::bigint as total, count(*) as n from dw join k using (g) join gains using (bucket) group by 1),
w as (select r, doc_id, len(w)::bigint as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight from d left join m using (r)),
e as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint as score from w),
o as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as place, (select count(*) from w where n_features >= 20) as fits from e)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * fits // 100 then place end::bigint as rank from o"""

ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_importance_resampling": IMPORTANCE_RESAMPLING,
}
