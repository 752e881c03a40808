"""Problem 7: the history of single-valued relationships in memory_edges."""
from __future__ import annotations

from ..operators.history import keep_history
from ..sources import table


def found(spark, folder):
    return keep_history(table(spark, folder, "memory_edges"), table(spark, folder, "relationship_kinds"))


FOUND_SQL = r"""
with kinds as (
  select relationship_name as kind, lower(regexp_replace(trim(relationship_name), '[\s_-]+', '_', 'g')) as plain
  from relationship_kinds where single_value),
rows_ as (
  select e.chat_id, e.source_id, k.kind as relationship_name, e.target_id, epoch_us(e.valid_at) as f,
         epoch_us(e.invalid_at) as t, epoch_us(e.created_at) as c, epoch_us(e.updated_at) as u, e.edge_no
  from memory_edges e join kinds k
    on lower(regexp_replace(trim(e.relationship_name), '[\s_-]+', '_', 'g')) = k.plain
  where e.chat_id is not null and e.source_id is not null and e.target_id is not null and e.valid_at is not null),
facts as (
  select *, case when t > f then t end as ends from rows_
  qualify row_number() over (partition by chat_id, source_id, relationship_name, target_id, f order by u desc, edge_no desc) = 1),
starts as (
  select * from facts
  qualify row_number() over (partition by chat_id, source_id, relationship_name, f order by c desc, edge_no desc) = 1),
held as (
  select *, least(ends, lead(f) over (partition by chat_id, source_id, relationship_name order by f)) as until from starts),
marked as (
  select *, case when lag(target_id) over s = target_id and lag(until) over s = f then 0 else 1 end as fresh
  from held window s as (partition by chat_id, source_id, relationship_name order by f)),
numbered as (
  select *, sum(fresh) over (partition by chat_id, source_id, relationship_name order by f) as v from marked)
select chat_id, source_id, relationship_name, cast(v as bigint) as version_no, min(target_id) as target_id,
       min(f) as valid_from_us,
       case when bool_or(until is null) then -1 else max(until) end as valid_to_us
from numbered group by chat_id, source_id, relationship_name, v
"""

QUERIES = {"p7_found": found}
SQL = {"p7_found": FOUND_SQL}
