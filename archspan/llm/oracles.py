"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, {_WORDS} as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select rid, i, array_to_string(ws[i:i+7], ' ') as gram from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8) x),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g) y where c > 1),
v as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from r) z group by rid),
s as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(v.n, 0) as bigint) as n_repeat_words,
    length(text) - length(regexp_replace(text, '\p{{L}}+', '', 'g')) as n_letters, length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) as n_capitals
  from w left join v on v.rid = w.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2 * n_words and 20 * n_words and 4 * n_symbols <= n_words and 2 * n_dup_lines <= n_lines and 2 * n_letters >= word_chars and 2 * n_capitals <= n_letters as kept
from (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s) q
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""
with d as (select row_number() over () as rid, doc_id, {_ITEM_WORDS} as ws from documents),
b as (select item_id, ws, least(13, len(ws)) as l from (select item_id, {_ITEM_WORDS} as ws from benchmark) x where len(ws) > 0),
n as (select distinct item_id, l, array_to_string(ws[k:k+l-1], ' ') as gram from (select item_id, ws, l, unnest(range(1, len(ws) - l + 2)) as k from b) x),
g as (select rid, l, i, array_to_string(ws[i:i+l-1], ' ') as gram from (select rid, ws, l, unnest(range(1, len(ws) - l + 2)) as i from d, (select distinct l from n) k where len(ws) >= l) x),
h as (select g.rid, g.i, g.l, n.item_id from g join n on n.l = g.l and n.gram = g.gram),
v as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + l)) as p from h) x group by rid),
m as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by rid)
select doc_id, n_words, n_hit, n_items, items_sha256, n_hit > 0 and 20 * n_hit >= n_words as contaminated from (
  select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(v.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items, sha256(coalesce(m.ids, '')) as items_sha256
  from d left join v on v.rid = d.rid left join m on m.rid = d.rid) q
"""

#: The conversations, and the call and the result made of every assistant's turn; a result goes behind its call.
CHAT_MESSAGES = """
with s as (select conv_id, turn, coalesce(text, '') as text, length(coalesce(text, '')) as n from conversations where role = 'assistant'),
a as (select *, '{"limit":' || case n % 3 when 2 then '"' || n || '"' else '' || n end || ',"text":' || cast(to_json(text) as varchar) || '}' as arguments from s),
t as (
  select conv_id, turn * 4 as place, 0 as late, turn, role, cast(0 as int) as n_calls, cast(0 as int) as n_invalid, cast(null as boolean) as linked,
    cast(to_json({'content': coalesce(text, ''), 'role': role}) as varchar) as message
  from conversations
  union all
  select -1 - conv_id, turn * 4 + 2, 0, turn * 4 + 2, 'assistant', 1, cast(n % 3 = 2 as int), null,
    '{"content":"","model":"m","role":"assistant","tool_calls":[{"function":{"arguments":' || case n % 3 when 1 then cast(to_json(arguments) as varchar) else arguments end || ',"name":"look_up"},"id":"c' || turn || '"}]}'
  from a
  union all
  select -1 - conv_id, case when turn % 5 = 4 then own else greatest(own, turn * 4 + 2) end, case when turn % 5 <> 4 and own < turn * 4 + 2 then 1 else 0 end, own, 'tool', 0, 0, turn % 5 <> 4,
    '{"content":' || cast(to_json(text) as varchar) || ',"is_error":false,"role":"tool","tool_call_id":"' || case when turn % 5 = 4 then 'x' else 'c' end || turn || '"}'
  from (select *, turn * 4 + case when turn % 2 = 0 then 3 else 1 end as own from a) r)
select conv_id, row_number() over (partition by conv_id order by place, late, turn, role, message) - 1 as position, turn, role, n_calls, n_invalid, linked, message from t
"""

SQL = {"op4_chat_messages": CHAT_MESSAGES, "op7_contamination": CONTAMINATION, "op8_quality_rules": QUALITY_RULES}
