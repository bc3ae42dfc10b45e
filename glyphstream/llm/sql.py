"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .chat_format import CONTROL, END, START, TEXT, TURN

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(column: str) -> str:
    out = f"replace({column}, {_quoted(chr(92))}, {_quoted(chr(92) * 2)})"
    for c in CONTROL:
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    return out


OP2 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    row_number() over (partition by conv_id order by turn, role, text) as k from c),
l as (select *, length({_escaped("text")}) + case
    when k = 1 then {len(START + TEXT)} + length({_escaped("role")})
    when before = role then {len(TURN)} else {len(END + START + TEXT)} + length({_escaped("role")}) end as n from p)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(n) + {len(END)})::bigint as formatted_chars
from l group by conv_id
"""

OP3 = """
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as d, min(page_id) over (partition by payload) as first from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(d, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31))::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from h
"""

OP8 = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from s),
k as (select *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, coalesce(doc_id > first, false) as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

#: Weights 5, 2, 1 in turn; 1.5 times all words; at most 2 times a source's size.
OP12 = r"""
with s as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u from documents),
g as (select source, sum(size)::bigint as words, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s group by source),
-- Sources in the order in which rising shares fill them up; the first one with room for its share ends that.
o as (select *, row_number() over (order by 2.0 * words / weight, source) as k from g where words > 0),
f as (select *, 1.5::double * sum(words) over () - coalesce(sum(2 * words) over (order by k rows between unbounded preceding and 1 preceding), 0)::double as room,
    sum(weight) over (order by k rows between current row and unbounded following) as open from o),
e as (select room, open, k from f where room * weight <= 2 * words * open order by k limit 1),
t as (select o.source, o.words, case when e.k is null or o.k < e.k then 2.0::double * words else e.room * weight / e.open::double end as target from o left join e on true
    union all select source, words, 0 from g where words = 0),
c as (select *, case when words > 0 then least(2, floor(target / words)) else 0 end as certain from t),
r as (select s.doc_id, s.size, c.words, c.target, c.certain, c.source, u / (1 - u) / (p / (1 - p)) as rank, p, s.size * 1000 > c.words as large
    from s join c on s.source is not distinct from c.source, lateral (select case when words > 0 then target / words - certain else 0 end as p)),
a as (select *, sum(size) over (partition by source order by rank, doc_id nulls first, size rows unbounded preceding) as after,
    sum(size) over (partition by source)::double * p as wanted from r where p > 0 and large),
d as (select *, after - size / 2.0::double <= wanted as taken from a),
n as (select source, sum(size) filter (taken) as got from d group by source),
b as (select r.*, sum(size) over (partition by r.source order by rank, doc_id nulls first, size rows unbounded preceding) as after,
    target - certain * words - coalesce(n.got, 0) as wanted from r left join n on r.source is not distinct from n.source where p > 0 and not large),
x as (select doc_id, size, words, target, certain, taken from d
    union all select doc_id, size, words, target, certain, after - size / 2.0::double <= wanted from b
    union all select doc_id, size, words, target, certain, false from r where not p > 0)
select doc_id, size, words as source_size, round(target::double, 6) as target, (size * (certain + taken::int))::bigint as taken from x
"""

SQL = {"op12_source_mixing": OP12, "op2_chat_formatting": OP2, "op3_warc": OP3, "op8_line_dedup": OP8}
