"""SQL of the operators whose results it can state: exact sets, exact cosines, exact substrings.

It compares all pairs and all windows, which is what a check on small tables can afford.
"""

#: documents linked by 100 * intersection >= 90 * union of their 3-word shingles
OP1 = r"""with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
d as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from t),
s as (select doc_id, len(g) as n, unnest(g) as x from d),
e as (select a.doc_id as u, b.doc_id as v from s a join s b on a.x = b.x and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (with recursive r(node, reached) as (select doc_id, doc_id from documents union select r.node, e.v from r join e on r.reached = e.u) select node, min(reached) as component_id from r group by 1)
select d.doc_id, cast(len(g) as bigint) as n_shingles, component_id from d join r on node = d.doc_id"""
#: bytes under 400-byte windows that occur twice; texts as hexadecimal digits, windows under MD5
OP6 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
k as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as m from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by m) as c from k) where c > 1),
isl as (select doc_id, min(i) as a, max(i) + 400 as z from (select *, sum(fresh) over (partition by doc_id order by i) as run from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end as fresh from rep)) group by doc_id, run),
cut as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from isl),
gone as (select doc_id, cast(sum(z - a) as bigint) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as kept from cut join d using (doc_id) group by doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join gone using (doc_id)"""
#: vectors of a label with cosine 0.98 or more
OP7 = """with f as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
o as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from f where label is not null and len(e) > 0 and list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) and list_dot_product(e, e) > 0),
l as (select a.vec_id as u, b.vec_id as v from o a join o b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r as (with recursive r(node, reached) as (select vec_id, vec_id from embeddings union select r.node, l.v from r join l on r.reached = l.u) select node, min(reached) as component_id from r group by 1)
select vec_id, (select count(*) from l where u = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join r on node = vec_id"""
#: versions and waiting sales by batch: what a start has seen, and what the starts before it have pruned; crc32 bit by bit
OP11 = r"""with recursive b(k) as (select unnest(range(0, 13))),
s as (select row_number() over () as r, sale_id, client_id, sold_at, greatest(0, least(11, floor((date_diff('day', date '1970-01-01', cast(arrived_at as date)) - 19723) * 12 / 152))) as a from sales),
bits as (select change_id, list_reduce(flatten(list_transform(string_split(cast(change_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda h, x: case when x >= 0 then xor(h, x) when h & 1 = 1 then xor(h >> 1, 3988292384) else h >> 1 end, 4294967295) as h from (select distinct cast(change_id as bigint) as change_id from client_changes)),
c as (select d.*, greatest(0, least(11, floor((date_diff('day', date '1970-01-01', cast(valid_at as date)) + xor(h, 4294967295) % 4 - 19723) * 12 / 152))) as a from (select distinct * from client_changes where valid_at is not null) d left join bits using (change_id)),
ws as (select k, (select max(sold_at) from s where a < k) as w from b), wc as (select k, (select max(valid_at) from c where a < k) as w from b),
h as (select k, case when ws.w is not null and wc.w is not null then least(ws.w, wc.w) end as h from ws join wc using (k)),
v as (select c.* from c join wc on a = k where not coalesce(valid_at < w, false)),
e as (select r, sale_id, client_id, sold_at, coalesce((select min(k) from h where k >= a and k < 12 and (sold_at is null or sold_at < h)), 12) as k from s),
n as (select client_id, k, v.valid_at, v.change_id, v.balance, v.op from (select distinct client_id, k from e) x join v using (client_id) where v.a <= k),
m as (select n.client_id, n.k, max((valid_at, change_id)) as top from n join h on h.k = n.k - 1 join v using (client_id, valid_at, change_id) where v.a < n.k and valid_at <= h group by 1, 2),
u as (select n.* from n left join m using (client_id, k) where m.top is null or (n.valid_at, n.change_id) >= m.top),
t as (select client_id, k, count(*) as n_held from u group by 1, 2),
f as (select r, arg_max((change_id, balance, op), (valid_at, change_id)) as x from e join u using (client_id, k) where valid_at <= sold_at group by 1)
select 'sale' as rec, sale_id as id, cast(e.k as bigint) as batch, cast(coalesce(n_held, 0) as bigint) as n_held, x[1] as change_id, cast(floor(100 * x[2] + 0.5) as bigint) as balance_cents, x[3] as op from e left join t using (client_id, k) left join f using (r)
union all select 'late', change_id, cast(a as bigint), null, null, null, null from c join wc on a = k where valid_at < w"""
#: runs from words that equal those q further on, by 6-word stretches that stand twice; of runs that a divisor's run covers none counts
OP13 = r"""with recursive bits as (select doc_id, list_reduce(flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda h, x: case when x >= 0 then xor(h, x) when h & 1 = 1 then xor(h >> 1, 3988292384) else h >> 1 end, 4294967295) as c from (select distinct doc_id from documents)),
t as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, xor(c, 4294967295) as h from documents left join bits using (doc_id)),
l as (select *, (h // 10) % greatest(len(w), 1) as a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) as p from t),
d as (select r, doc_id, case when h % 10 = 0 and len(w) > 0 then list_transform(range(len(w)), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from l),
s as (select r, i, md5(array_to_string(w[i + 1:i + 6], ' ')) as m from (select r, w, unnest(range(0, greatest(len(w) - 5, 0))) as i from d)),
e as (select x.r, x.i, y.i - x.i as q from s x join s y on x.r = y.r and x.m = y.m and x.i < y.i),
g as (select r, q, min(i) as start, count(*) + 5 + q as length from (select *, i - row_number() over (partition by r, q order by i) as z from e) group by r, q, z having count(*) + 5 + q >= greatest(12, 2 * q)),
u as (select * from g where not exists (select 1 from g f where f.r = g.r and f.q < g.q and g.q % f.q = 0 and f.start <= g.start and f.start + f.length >= g.start + g.length)),
b as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines, arg_max((start, length, q), (length, -start, -q)) as top from u group by r),
k as (select r, string_agg(x, ' ' order by i) as kept from (select r, unnest(w) as x, unnest(range(0, len(w))) as i from d) v where not exists (select 1 from u where u.r = v.r and v.i >= u.start + u.q and v.i < u.start + u.length) group by r)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(top[1] as bigint) as start, cast(top[2] as bigint) as length, cast(top[3] as bigint) as period, cast(1000 * top[2] // top[3] as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from d left join b using (r) left join k using (r)"""
