"""The adapter views of ``pacegrid.sources.adapters`` as SQL text.

Used as CTEs in the DuckDB oracle statements (``pacegrid.plans.oracle``).
They are written independently of the DataFrame code; equal results of the
two are what the correctness check tests.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "users": "select c_custkey id, c_name username from customer",
    "problems": """
select o.o_orderkey id, o.o_custkey user_id, concat('item ', cast(o.o_orderkey as varchar)) name,
  p.p_type category, p.p_name topic,
  case o.o_orderpriority when '5-LOW' then 'Easy' when '3-MEDIUM' then 'Medium'
       when '4-NOT SPECIFIED' then 'High' else 'Hard' end difficulty,
  case when o.o_orderstatus='F' then 'Solved' when o.o_orderstatus='O' then 'Pending'
       when o.o_orderkey%2=0 then 'Attempted' else 'Skipped' end status,
  cast(o.o_orderdate as date) scheduled_date,
  concat('batch_', cast(p.p_partkey as varchar)) import_batch,
  'Custom' platform, '' problem_link, '' resource_link
from (select orders.*, o_orderkey % n part_no from orders, (select count(*) n from part)) o join part p on o.part_no = p.p_partkey""",
    "daily_log": """
select user_id, cast(ts as date) log_date,
  count_if(event_type='purchase')::bigint problems_solved,
  count_if(event_type='click')::bigint problems_attempted,
  count_if(event_type='error')::bigint problems_skipped,
  10::bigint problems_target
from events group by user_id, cast(ts as date)""",
    "daily_plan": """
select o.o_custkey user_id, cast(l.l_shipdate as date) plan_date, l.l_orderkey problem_id,
  l.l_linenumber order_index,
  case l.l_returnflag when 'R' then 'Solved' when 'A' then 'Pending' else 'Skipped' end status
from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "projects": """
select o_orderkey id, o_custkey user_id, concat('project ', cast(o_orderkey as varchar)) name,
  cast(o_orderdate as date) target_date from orders""",
    "milestones": """
select l_orderkey project_id, l_linenumber order_index, cast(l_shipdate as date) deadline,
  case when l_linestatus='F' then 'Done' else 'Pending' end status from lineitem""",
    "algorithms": "select p_partkey id, p_name name, p_type pattern, p_brand description from part",
    "settings": """
select c_custkey user_id, 'name' key, c_name value from customer
union all select c_custkey, 'daily_goal', cast(c_custkey%13 as varchar) from customer
  where c_mktsegment <> 'BUILDING'
union all select c_custkey, 'placement_deadline',
  case when c_nationkey%2=0 then '2024-03-01' else '2024-01-05' end from customer
  where c_mktsegment <> 'MACHINERY'""",
    "articles": """
select doc_id seq, source, concat('doc://', cast(doc_id as varchar)) url,
  text title, n_chars score, lang tag_hint from documents""",
    "feedback": """
select conv_id * 1000 + turn id, conv_id user_id, date '2024-01-01' + (turn // 4)::integer feedback_date,
  case turn % 3 when 0 then 'daily' when 1 then 'coach' else 'weekly' end feedback_type, text content,
  'rule-based' model_used
from conversations where role = 'assistant'""",
    "imports": """
select min(o.o_orderkey) id, o.o_custkey user_id, concat(p.p_name, '.csv') filename,
  concat('batch_', cast(p.p_partkey as varchar)) batch_id, p.p_size%2=0 protected,
  count(*)::bigint total_imported, min(cast(o.o_orderdate as date)) import_date
from (select orders.*, o_orderkey % n part_no from orders, (select count(*) n from part)) o join part p on o.part_no = p.p_partkey
group by o.o_custkey, p.p_partkey, p.p_name, p.p_size""",
    "prompts": """
select conv_id, turn, concat(text, case conv_id%5 when 0 then ' my progress today'
  when 1 then ' weekly news' when 2 then ' give me a sliding window tutorial'
  when 3 then ' what should i plan' else '' end) message
from conversations where role='user'""",
    "tasks": """
select p_partkey seq, p_partkey%15 user_id, p_name name, p_type topic, p_brand category from part
union all
select id + 10000000000 seq, user_id, concat(' ', name, ' ') name, topic, category
from problems where status='Skipped'""",
    "status_events": """
select o.o_custkey user_id, l.l_orderkey problem_id, cast(l.l_shipdate as date) plan_date,
  case when l.l_discount > 0.05 then 'Solved' else 'Attempted' end status,
  l.l_shipdate + l.l_linenumber * interval 1 hour ts
from lineitem l join orders o on l.l_orderkey = o.o_orderkey where l.l_linestatus='O'""",
    "activity": """
select user_id, cast(ts as date) log_date, count(*)::bigint problems_solved, max(ts) ts
from events where event_type='view' group by user_id, cast(ts as date)""",
    "user_settings": """
select u.id user_id, coalesce(max(case when s.key='name' then s.value end), 'Student') name,
  coalesce(try_cast(max(case when s.key='daily_goal' then s.value end) as bigint), 10) daily_goal,
  coalesce(try_cast(max(case when s.key='placement_deadline' then s.value end) as date),
           date '2026-10-01') placement_deadline
from users u left join settings s on s.user_id = u.id
group by u.id""",
    "sheet_cells": """
select 'bank.xlsx' source_file, 'DSA Sheet' sheet, p_partkey::bigint row_no, 1 col_no, 'Problem' header,
  case when p_size%10=0 then 'nan' when p_size%10=5 then ' NONE ' else p_name end value from part
union all select 'bank.xlsx', 'DSA Sheet', p_partkey, 2, 'Topic', p_type from part
union all select 'bank.xlsx', 'DSA Sheet', p_partkey, 3, ' LEVEL ',
  case p_size%4 when 0 then 'easy' when 1 then 'HARD' when 2 then ' must ' else 'Optional' end from part
union all select 'bank.xlsx', 'DSA Sheet', p_partkey, 4, 'Link',
  case p_partkey%3 when 0 then 'leetcode.com/problems/' || replace(p_name, ' ', '-')
       when 1 then '//www.geeksforgeeks.org/' || lower(p_brand) else 'nan' end from part
union all select 'bank.xlsx', 'DSA Sheet', p_partkey, 5, 'Due',
  case p_partkey%4 when 0 then strftime(date '2026-01-01' + (p_partkey%300)::integer, '%Y-%m-%d')
       when 1 then strftime(date '2026-01-01' + (p_partkey%300)::integer, '%m/%d/%Y')
       when 2 then strftime(date '2026-01-01' + (p_partkey%300)::integer, '%d/%m/%Y')
       else 'Day ' || cast(p_partkey%30 as varchar) end from part
union all select 'bank.xlsx', 'DSA Sheet', p_partkey, 6, 'topic', p_brand from part
union all select 'bank.xlsx', 'Topics', n_nationkey, 1, 'Topic', n_name from nation
union all select 'bank.xlsx', 'Topics', n_nationkey, 2, 'Priority',
  case n_nationkey%3 when 0 then 'Must' when 1 then 'low' else 'nan' end from nation
union all select 'bank.xlsx', 'Topics', n_nationkey, 3, 'Ref', 'site.org/' || lower(n_name) from nation
union all select 'plan.csv', 'Week Plan', o_orderkey, 1, 'Day',
  case when o_orderstatus='P' then 'nan' else 'Day ' || cast(o_orderkey%30+1 as varchar) end from orders
union all select 'plan.csv', 'Week Plan', o_orderkey, 2, 'DSA', o_orderpriority from orders
union all select 'plan.csv', 'Week Plan', o_orderkey, 3, 'Aptitude',
  case when o_orderstatus='O' then '' else 'apt ' || cast(o_custkey as varchar) end from orders
union all select 'plan.csv', 'Week Plan', o_orderkey, 4, 'HR round',
  case when o_orderkey%7=0 then 'none' else 'intro' end from orders
union all select 'plan.csv', 'Week Plan', o_orderkey, 5, 'System Design', 'sd ' || cast(o_custkey%9 as varchar)
  from orders
union all select 'plan.csv', 'Week Plan', o_orderkey, 6, 'Misc', 'm' || cast(o_custkey%5 as varchar) from orders
union all select 'misc.csv', 'hr round', n_nationkey, 1, 'c1', n_name from nation
union all select 'misc.csv', 'hr round', n_nationkey, 2, 'c2',
  case when n_regionkey=0 then 'nan' else 'Region ' || cast(n_regionkey as varchar) end from nation
union all select 'misc.csv', 'hr round', n_nationkey, 3, 'c3',
  case when n_nationkey%2=0 then 'http://x.y/' || cast(n_nationkey as varchar) else '' end from nation""",
}

# Views that other views read, in dependency order.
_DEPS = {
    "tasks": ["problems"],
    "user_settings": ["users", "settings"],
}


def with_views(names: list[str], body: str) -> str:
    """``WITH v1 AS (...), v2 AS (...) <body>`` for the given views (+deps)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}"
