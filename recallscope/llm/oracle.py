"""DuckDB twins of the operators' queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {WORDS} as w from documents),
starts as (select doc_id, unnest(range(1, len(w) - 48)) as p, w from d where len(w) >= 50),
win as (select doc_id, p, array_to_string(w[p:p + 49], ' ') as s from starts),
least as (select s, min(doc_id) as m from win group by s),
hit as (select doc_id, p from win join least using (s) where m < doc_id),
gone as (select doc_id, list(distinct p + k) as g from hit, (select unnest(range(50)) as k) group by doc_id),
kept as (
  select doc_id, len(w) as n_words, len(coalesce(g, [])) as n_removed,
         case when g is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(g, i)] end as k
  from d left join gone using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""

JACCARD_JOIN = rf"""
with recursive d as (select doc_id, {WORDS} as w from documents),
grams as (
  select doc_id, unnest(case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
                             when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by x, y),
links as (
  select x, y from shared join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 9 * c >= 4 * (s.n + t.n)),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) as m from reach group by x),
degree as (select x, count(*) as n from links group by x),
copies as (select array_to_string(w, ' ') as s, count(*) as n from d where len(w) > 0 group by s)
select doc_id, least(doc_id, coalesce(m, doc_id)) as class_id, coalesce(g.n, 0) as n_links, coalesce(c.n, 1) as n_copies,
  coalesce(m >= doc_id, true) as keep
from d left join least l on l.x = doc_id left join degree g on g.x = doc_id left join copies c on c.s = array_to_string(d.w, ' ')
"""

PFAIR_MIX = """
with recursive sizes as (
  select source, greatest(1, coalesce(sum(length(text)), 0)) as n from documents group by source),
exact as (
  select source, pow(cast(n as double), 0.7) / sum(pow(cast(n as double), 0.7)) over () * 1000 as e from sizes),
floored as (select source, e, greatest(1, cast(floor(e) as bigint)) as f from exact),
shares as (
  select source, f + case when row_number() over (order by f - e, source) <= 1000 - sum(f) over () then 1 else 0 end as w,
    row_number() over (order by source) as i
  from floored),
weights as (select list(w order by i) as ws from shares),
schedule(t, done, pick) as (
  select -1, [0 for w in ws], 0 from weights
  union all
  select t + 1, [case when j = p then done[j] + 1 else done[j] end for j in range(1, len(done) + 1)], p from (
    select t, done, list_sort([
        {'due': cast(ceil((done[j] + 1) * 1000.0 / ws[j]) as bigint), 'i': j} for j in range(1, len(ws) + 1)
        if floor(done[j] * 1000.0 / ws[j]) <= t + 1])[1].i as p
    from schedule, weights where t < 999)),
slots as (
  select pick as i, t as slot, row_number() over (partition by pick order by t) - 1 as ordinal from schedule where t >= 0),
placed as (
  select doc_id, source, coalesce(sum(coalesce(length(text), 0)) over (
      partition by source order by md5(cast(doc_id as varchar)), doc_id rows between unbounded preceding and 1 preceding), 0) as b
  from documents),
blocks as (
  select doc_id, source, cast(b // 8192 + 1 as bigint) as block, cast(b % 8192 as bigint) as block_offset from placed)
select b.doc_id, b.source, b.block, b.block_offset,
  cast(floor((b.block - 1) * 1000.0 / w) as bigint) as release, cast(ceil(b.block * 1000.0 / w) as bigint) as deadline,
  cast(((b.block - 1) // w) * 1000 + slot as bigint) as slot
from blocks b join shares s using (source) join slots k on k.i = s.i and k.ordinal = (b.block - 1) % w
"""

HARD_NEGATIVES = """
with e as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
scored as (
  select a.id as a, c.id as c, a.label = c.label as same,
    cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) as bigint) as s
  from e a join e c on a.id <> c.id where a.id % 100 = 0),
positives as (
  select a, c, s from scored where same qualify row_number() over (partition by a order by s desc, c) <= 5),
negatives as (
  select p.a, p.c as p, p.s as ps, n.c as n, n.s as ns, row_number() over (partition by p.a, p.c order by n.s desc, n.c) as r
  from positives p join scored n on n.a = p.a where not n.same and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s)
select a as anchor_id, p as positive_id, cast(r as integer) as rank, n as negative_id, ps as positive_score, ns as negative_score
from negatives where r <= 10
"""

PHRASE_COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) as phrase
  from w, (select unnest([1, 2, 3, 4]) as m)),
f as (select lang, m, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f) as n from f where m = 1 group by lang),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m >= 2 and f >= 30),
cuts as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r,
    cast((cast(2000000 as hugeint) * c.a) // (x.f + y.f) as bigint) as score
  from (select lang, phrase, a, ws, m as size, unnest(range(1, m)) as k from candidates) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1:size], ' ')),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_phrases as (
  select lang, a, array_to_string(ws[i:i + k - 1], ' ') as phrase
  from (select *, unnest(range(1, m - k + 2)) as i from (select *, unnest(range(2, m)) as k from candidates))),
replaced as (select distinct s.lang, s.phrase from scored s join inner_phrases p using (lang, phrase) where 100 * p.a >= 80 * s.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from scored anti join replaced using (lang, phrase))
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join totals using (lang) where rank <= 2000
"""

RING_SHARDS = """
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
    from (select unnest(range(256)) as i))),
docs as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
sums as (
  select doc_id, strlen(text) + 8 as size, xor(list_reduce(list_prepend(4294967295, list_transform(
    range(0, strlen(text)), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) as text_crc32,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as spot
  from docs, crc_table),
spots as (
  select spot, shard, row_number() over (order by spot, shard) - 1 as i
  from (select s as shard, cast('0x' || substr(md5('shard ' || s || ' point ' || v), 1, 15) as bigint) as spot
        from (select unnest(range(24)) as s), (select unnest(range(256)) as v))),
keys as (
  select doc_id, size, text_crc32, k.spot, coalesce(p.i + 1, 0) as arc, row_number() over (order by k.spot, doc_id) - 1 as along
  from sums k asof left join spots p on k.spot > p.spot),
arcs as (select arc, count(*) as n, min(along) as low from keys group by arc),
tries as (
  select arc, shard, row_number() over (partition by arc order by away) - 1 as hop
  from (select arc, shard, min((i - arc + 2 * 6144) % 6144) as away from arcs, spots group by arc, shard)),
room as (
  select s as shard, (select count(*) from keys) // 24 + case when s < (select count(*) from keys) % 24 then 1 else 0 end as most
  from (select unnest(range(24)) as s)),
rounds as (  -- arcs (arc >= 0: where their waiting keys start, how many) and shards (arc = -1 - shard: free places)
  select cast(-1 as bigint) as hop, arc, low, n as waiting, cast(0 as bigint) as taken, cast(-1 as bigint) as shard from arcs
  union all
  select -1, -1 - shard, 0, most, 0, -1 from room
  union all (
    select hop, arc, low, waiting - take, take, shard from (
      select r.hop + 1 as hop, r.arc, r.low + r.taken as low, r.waiting, t.shard, greatest(0, least(r.waiting, f.waiting - coalesce(
        sum(r.waiting) over (partition by t.shard order by r.arc rows between unbounded preceding and 1 preceding), 0))) as take
      from rounds r join tries t on t.arc = r.arc and t.hop = r.hop + 1 join rounds f on f.arc = -1 - t.shard
      where r.arc >= 0 and r.waiting > 0)
    union all
    select f.hop + 1, f.arc, 0, greatest(0, f.waiting - coalesce(asked, 0)), 0, -1
    from rounds f left join (
      select t.shard, sum(r.waiting) as asked from rounds r join tries t on t.arc = r.arc and t.hop = r.hop + 1
      where r.arc >= 0 and r.waiting > 0 group by t.shard) d on f.arc = -1 - d.shard
    where f.arc < 0 and exists (select 1 from rounds w where w.arc >= 0 and w.waiting > 0))),
runs as (
  select low, taken, shard, cast(hop as integer) as hops,
    coalesce(sum(taken) over (partition by shard order by low rows between unbounded preceding and 1 preceding), 0) as first_slot
  from rounds where taken > 0)
select doc_id, size, text_crc32, 'rows' as law, cast(shard as integer) as shard, cast(first_slot + along - low as bigint) as slot,
  cast(null as integer) as grown_shard, hops
from keys asof join runs on keys.along >= runs.low
"""
