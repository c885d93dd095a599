"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

# Chats: the texts of the turns themselves, which the operator must give back, and the template's length.
CHAT = """
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked as (
  select *, coalesce(lag(role) over w = role, false) as same,
         length(replace(replace(text, '%', '%25'), '<|', '<%7C')) as text_chars,
         length(replace(replace(replace(role, '%', '%25'), '<|', '<%7C'), chr(10), '%0A')) as role_chars
  from rows_ window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, cast(count(*) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(text_chars + case when same then length('<|im_sep|>') else length('<|im_start|>') + role_chars + 1 + length('<|im_end|>') + 1 end) as bigint) as formatted_chars
from marked group by conv_id
"""

# Sharding: the same fold over the turns, as a recursive query.
SHARDING = """
with recursive prefs as (
  select k, 'shard-' || lpad(cast(k as varchar), 2, '0') as shard,
         ('0x' || substr(md5('offset:shard-' || lpad(cast(k as varchar), 2, '0')), 1, 15))::bigint % 2039 as off_,
         ('0x' || substr(md5('skip:shard-' || lpad(cast(k as varchar), 2, '0')), 1, 15))::bigint % 2038 + 1 as skip_
  from range(16) t(k)
), orders as (
  select k, list((off_ + j * skip_) % 2039 order by j) as slots from prefs, range(2039) r(j) group by k
), all_orders as (select list(slots order by k) as o from orders
), fill(t, owner, slot) as (
  select -1::bigint, list_transform(range(2039), lambda x: -1::bigint), -1::bigint
  union all
  select t + 1, list_transform(owner, lambda x, i: case when i = s + 1 then (t + 1) % 16 else x end), s
  from (select t, owner, list_filter(o[(t + 1) % 16 + 1], lambda s: owner[s + 1] < 0)[1] as s from fill, all_orders where t + 1 < 2039)
), lookup as (
  select slot, cast(t % 16 as integer) as shard_id from fill where t >= 0
)
select d.doc_id, cast(d.slot as integer) as slot, l.shard_id, 'shard-' || lpad(cast(l.shard_id as varchar), 2, '0') as shard
from (select doc_id, ('0x' || substr(md5('key:' || coalesce(cast(doc_id as varchar), 'null key')), 1, 15))::bigint % 2039 as slot from documents) d
join lookup l on d.slot = l.slot
"""

ORACLES = {"op3_chat": CHAT, "op6_sharding": SHARDING}
