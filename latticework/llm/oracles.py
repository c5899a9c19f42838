"""SQL that gives the rows of the registered queries, where SQL can express them."""

from latticework.llm.licenses import RULES, SENTENCES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KNOWN = ", ".join(_quoted(s) for s in SENTENCES.values())
_NAMES = "map {" + ", ".join(f"{_quoted(s)}: {_quoted(name)}" for name, s in SENTENCES.items()) + "}"
_MATCHES = ", ".join(f"case when contains(a, {_quoted(' ' + ' '.join(ids) + ' ')}) or contains(b, {_quoted(' ' + ' '.join(ids) + ' ')}) then {_quoted(name)} end" for name, ids in RULES)


def _ids(parts: str) -> str:
    return f"list_transform(list_filter(list_transform({parts}, lambda s: trim(s)), lambda s: s in ({_KNOWN})), lambda s: {_NAMES}[s])"


OP2 = f"""
with t as (
  select doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.!?;:]+([\\x20\\x09-\\x0D]|\\z)', chr(1) || '\\1', 'g'),
    '[^a-z0-9\\x01\\x0A]+', ' ', 'g') as clean from documents),
i as (
  select doc_id, {_ids("string_split_regex(clean, '[\\x20\\x01\\x0A]*[\\x01\\x0A][\\x20\\x01\\x0A]*')")} as line_ids,
    {_ids("string_split_regex(regexp_replace(clean, '[\\x20\\x0A]+', ' ', 'g'), '[\\x20\\x01]*\\x01[\\x20\\x01]*')")} as text_ids from t),
s as (select *, ' ' || array_to_string(line_ids, ' ') || ' ' as a, ' ' || array_to_string(text_ids, ' ') || ' ' as b from i),
m as (select *, list_filter([{_MATCHES}], lambda x: x is not null) as found from s),
n as (select *, list_filter(found, lambda x, k: list_position(found, x) = k) as licenses from m)
select doc_id, cast(len(list_distinct(list_concat(line_ids, text_ids))) as bigint) as n_known, array_to_string(line_ids, ',') as sentence_ids,
       array_to_string(licenses, ',') as licenses, licenses[1] as license
from n
"""

OP4 = f"""
with d as (select row_number() over () as doc, doc_id, {_ITEM_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item_id, {_ITEM_WORDS} as w from benchmark),
iw as (select item_id, w, least(len(w), 13) as n, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as s from i where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as phrase from iw),
lengths as (select distinct n from windows),
dw as (select doc, w, n, unnest(range(0, len(w) - n + 1)) as s from d, lengths where len(w) >= n),
met as (select doc, s, x.n, item_id from (select doc, s, n, array_to_string(w[s + 1 : s + n], ' ') as phrase from dw) x join windows using (n, phrase)),
hit as (select doc, count(distinct pos) as n_hit from (select doc, unnest(range(s, s + n)) as pos from met) group by doc),
ids as (select doc, list_sort(list(distinct item_id)) as item_ids from met where item_id is not null group by doc)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(item_ids), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(item_ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc) left join ids using (doc)
"""

OP5 = r"""
with sizes as (
  select doc_id, source as src, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '-') || ':' || md5(coalesce(text, ''))) as row_dig
  from documents),
spread as (
  select *, case when which = 0 then row_dig else md5(row_dig || ':' || which) end as dig
  from (select *, row_number() over (partition by src, row_dig, doc_id, size) - 1 as which from sizes)),
by_src as (
  select src, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by src is null, src) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sizes group by src),
caps as (
  select *, source_size * 3 as cap, cast(source_size * 3 as double) / weight as ratio, cast(sum(source_size) over () as double) as budget from by_src),
ranked as (
  select *, (budget - coalesce(sum(cap) over (order by ratio, src is null, src rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, src is null, src rows between current row and unbounded following) as level,
    row_number() over (order by ratio, src is null, src) as rank
  from caps),
opened as (select min(rank) as rank, arg_min(level, rank) as level from ranked where cap > level * weight),
targets as (
  select r.src, r.source_size, r.budget,
         case when o.rank is not null and r.rank >= o.rank then least(cast(r.cap as double), o.level * r.weight) else cast(r.cap as double) end as target
  from ranked r cross join opened o),
placed as (
  select s.*, t.source_size, t.budget, t.target,
         sum(s.size) over (partition by s.src order by s.dig, s.doc_id, s.size rows unbounded preceding) as through,
         row_number() over (partition by s.src order by s.dig, s.doc_id, s.size) as place
  from spread s join targets t on s.src is not distinct from t.src),
copies as (
  select p.*, e.epoch, case when target > 0 then cast(through + (e.epoch - 1) * source_size as double) / target end as finish
  from placed p cross join (values (1), (2), (3)) e(epoch)),
timed as (
  select *, sum(size) over (order by finish nulls last, src is null, src, place, epoch rows unbounded preceding) as position from copies)
select any_value(doc_id) as doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
       cast(sum(case when finish is not null and position <= budget then size else 0 end) as bigint) as taken
from timed group by src, place
"""

OP10 = f"""
with recursive d as (
  select row_number() over () as doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k : k + 2], ' '))) end as g from d),
t as (select doc, len(g) as n, unnest(g) as token from s),
pairs as (
  select a.doc as x, b.doc as y from t a join t b on a.token = b.token and a.doc < b.doc
  group by a.doc, b.doc, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges as (select x, y from pairs union select y, x from pairs),
reach as (select doc as x, doc as y from d union select r.x, e.y from reach r join edges e on r.y = e.x),
low as (select x, min(doc_id) as component_id from reach join d on d.doc = reach.y group by x)
select doc_id, cast(len(g) as bigint) as n_shingles, component_id from s join low on low.x = s.doc
"""

OP6 = """
with p as (select page_id, coalesce(html, '') as html, row_number() over (order by page_id) as r from pages),
h as (select page_id, r, html, sha1(html) as hex, row_number() over (partition by html order by page_id, r) as place, min(page_id) over (partition by html) as first from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((cast(('0x' || substr(hex, 1 + 5 * (k // 4), 5)) as integer) >> (5 * (3 - k % 4))) & 31), 1)), '') as payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type, case when place > 1 then first end as refers_to
from h
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": OP2, "op4_decontamination": OP4, "op5_mixing": OP5, "op6_warc": OP6, "op10_ngram_join": OP10}
