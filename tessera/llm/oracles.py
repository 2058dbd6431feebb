"""The queries' twins in DuckDB's SQL, where SQL can say them."""

from tessera.llm.quality_rules import STOP_WORDS

#: For the layout of these pages: one article of headings and paragraphs.
OP1 = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) as h from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) as b from a),
u as (select page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as b from b),
t as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) as text from u)
select page_id, url, text, length(text) as n_chars from t
"""

#: Slots by their numbers' turned bits, ranked within a source by counting; documents in the order of a digest.
OP3 = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, count(*) as n_docs, cast(sum(size) as bigint) as source_size, row_number() over (order by encode(source) nulls last) - 1 as number from d group by source),
c as (select *, case number % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, cast(3 * source_size as double) as cap from s),
o as (select *, row_number() over (order by cap / weight, number) as place,
  (cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by cap / weight, number rows between unbounded preceding and 1 preceding), 0)) /
  (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, number rows between unbounded preceding and 1 preceding), 0)) as level from c),
l as (select min_by(level, place) as level from o where level * weight <= cap),
t as (select o.* exclude (level), case when l.level is null then cap else least(cap, l.level * weight) end as target, coalesce('s' || source, 'n') as key, greatest(1, least(512, source_size // 256)) as words from o, l),
q as (select *, cast(round(target / words) as bigint) as quota, (source_size + words - 1) // words as blocks from t where source_size > 0 and target > 0),
e as (select *, sum(quota) over (order by encode(key)) as upto, sum(quota) over () as total from q where quota > 0),
r as (select key, quota, blocks, cast(floor(cast(upto - quota as double) / total * 17592186044416.0::double) as bigint) as low, case when upto = total then 17592186044416 else cast(floor(cast(upto as double) / total * 17592186044416.0::double) as bigint) end as high from e),
n as (select unnest(range(0, (select coalesce(cast(max(total) as bigint), 0) + coalesce(cast(max(total) as bigint), 0) // 256 + 88 from e))) as slot),
p as (select slot, list_sum(list_transform(range(0, 44), lambda b: ((slot >> b) & 1) << (43 - b))) as point from n),
k as (select slot, key, blocks, quota, row_number() over (partition by key order by slot) - 1 as rank from p join r on low <= point and point < high),
m as (select key, rank % blocks as block, count(*) as times from k where rank < quota group by all),
g as (select doc_id, key, size, source_size, target, words, md5(coalesce(cast(doc_id as varchar), '') || ' 17') as ord, n_docs from d join t on d.source is not distinct from t.source),
h as (select *, cast('0x' || substr(ord, 1, 12) as bigint) % cast(ceil(n_docs / 4096) as bigint) as cell from g),
a as (select *, row_number() over () as nr, cast(coalesce(sum(size) over (partition by key order by cell, ord, size rows between unbounded preceding and 1 preceding), 0) as bigint) as first from h),
b as (select nr, first, size, words, key, unnest(range(first // words, (first + size - 1) // words + 1)) as block from a where size > 0),
f as (select nr, cast(sum(times * (least(first + size, (block + 1) * words) - greatest(first, block * words))) as bigint) as taken from b join m using (key, block) group by nr)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken from a left join f using (nr)
"""

#: Windows as hexadecimal digits, two a byte.
OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d)),
m as (select s, min(doc_id) as f from w group by s having min(doc_id) < max(doc_id)),
r as (select w.doc_id, w.i from w join m using (s) where m.f < w.doc_id),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from r),
k as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from g),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from k group by doc_id, k),
parts as (select runs.doc_id, a, b, coalesce(lag(b) over (partition by runs.doc_id order by a), 0) as e, h from runs join d using (doc_id)),
p as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' order by a) as lead, max(b) as e from parts group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(lead, '') || substr(h, 2 * coalesce(e, 0) + 1))) as kept_sha256
from d left join p using (doc_id)
"""

_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)
OP4 = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
i as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w),
s as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from i),
m as (select doc_id, s from s group by all having count(*) > 1),
c as (select doc_id, count(distinct k) as n_repeat_words from (select s.doc_id, unnest([i, i + 1, i + 2]) as k from s join m using (doc_id, s)) group by 1),
n as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, len(list_filter(w, lambda x: x in ({_STOP}))) as n_stop_words from w left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2.0 and 14.0 and n_symbols / n_words <= 0.2 and n_stop_words / n_words >= 0.04 and n_dup_lines / n_lines <= 0.3 and n_repeat_words / n_words <= 0.5 as kept from b
"""

#: All links by their common shingles; classes as what links lead to.
OP6 = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
e as (select a, b from l union select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, least(a, min(b)) as class_id from r group by a)
select w.doc_id, coalesce(m.class_id, w.doc_id) as class_id, coalesce(n.n, 0) as n_shingles from w left join m using (doc_id) left join n using (doc_id)
"""

OP7 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (
  select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.e, d.e) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP9 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
w as (select *, max(page_id) over (partition by d) as top from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < top then top end as refers_to
from w
"""

SQL = {"op1_html_extraction": OP1, "op2_suffix_array_dedup": OP2, "op3_source_mixing": OP3, "op4_quality_rules": OP4, "op6_simhash_dedup": OP6, "op7_exact_topk": OP7, "op9_arc_to_warc": OP9}
