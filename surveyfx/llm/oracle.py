"""Reference SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op2_topk"] = """
with v as (
  select vec_id, [floor(1024 * x::double) for x in embedding] q from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0
)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored) where rank <= 10
"""

SQL["op3_warc"] = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, upper(sha1(coalesce(html, ''))) hex from pages
), g as (select *, max(page_id) over (partition by hex, payload_bytes) response from p)
select page_id, payload_bytes,
  array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)
    for i in generate_series(0, 31)], '') payload_digest,
  case when page_id = response then 'response' else 'revisit' end record_type,
  case when page_id <> response then response end refers_to
from g
"""

SQL["op7_lines"] = r"""
with d as (select row_number() over () r, doc_id, text, source, string_split(text, chr(10)) parts from documents),
l as (select r, source, unnest(parts) raw, generate_subscripts(parts, 1) place from d where text is not null),
b as (select trim(raw, ' ') line from l where trim(raw, ' ') <> '' group by 1 having count(distinct source) >= 10),
k as (
  select r, count(*) n_lines, count(*) filter (where b.line is not null) n_removed,
    coalesce(string_agg(raw, chr(10) order by place) filter (where b.line is null), '') kept
  from l left join b on trim(raw, ' ') = b.line group by r
)
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(kept) text_sha256 from d left join k using (r)
"""

SQL["op12_merkle"] = r"""
with recursive c32 as (
  select [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) for i in range(256)] t
), d as (
  select doc_id, source, '-' || coalesce(source, '') g0, case when source is null then '-' else '=' || source end tree, lang, n_chars, text,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low,
    xor(list_reduce([4294967295] || [ascii(x)::bigint for x in regexp_extract_all(doc_id::varchar, '.')], lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) crc
  from documents, c32
), l as (
  select doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf,
    case when crc % 5 = 0 then sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) end altered
  from d
), p as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by tree) n from l
), up as (
  select tree, 0 lv, idx, leaf hash, n from p
  union all
  select tree, lv + 1, idx // 16, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 15) // 16 from up where n > 1 group by tree, lv, idx // 16
), sub as (select tree, hash, row_number() over (order by tree) - 1 idx, count(*) over () n from up where n = 1
), tp as (
  select lv, idx, hash, n from (select 0 lv, idx, hash, n from sub)
  union all
  select lv + 1, idx // 16, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 15) // 16 from tp where n > 1 group by lv, idx // 16
), runs as (
  select tree, lv, idx // 16 run, string_agg(hash, '' order by idx) r from up where n > 1 group by all
  union all
  select '', lv, idx // 16, string_agg(hash, '' order by idx) from tp where n > 1 group by all
), lp as (
  select p.tree, p.idx, p.leaf, p.altered, p.doc_id, s.idx top, s.hash subroot, p.n,
    (select max(lv) + 1 from up where up.tree = p.tree and up.n > 1) depth, (select hash from tp where n = 1) root
  from p join sub s on p.tree = s.tree
), fold as (
  select tree, idx, 0 step, idx pos, coalesce(altered, leaf) h, '' proof, coalesce(depth, 0) depth, top from lp
  union all
  select f.tree, f.idx, f.step + 1,
    case when f.step < f.depth then f.pos else case when f.step = f.depth then f.top else f.pos end end // 16,
    sha256(r[1 : 64 * k] || f.h || r[64 * k + 65 :]), f.proof || r[1 : 64 * k] || r[64 * k + 65 :], f.depth, f.top
  from (select *, (case when step = depth then top else pos end) % 16 k, (case when step = depth then top else pos end) // 16 run from fold) f
  join runs on runs.tree = case when f.step < f.depth then f.tree else '' end and runs.lv = case when f.step < f.depth then f.step else f.step - f.depth end and runs.run = f.run
), done as (select tree, idx, max_by(h, step) folded_root, max_by(proof, step) proof from fold group by tree, idx)
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, folded_root, folded_root = root verified
from lp join done using (tree, idx)
"""

SQL["op13_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, [floor(256 * x::double) for x in embedding] q from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id anchor_id, b.vec_id id, list_inner_product(a.q, b.q)::bigint score, a.lab = b.lab same
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0
), p as (
  select anchor_id, id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::int rank, s.id negative_id, positive_score, s.score negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify rank <= 5
"""
