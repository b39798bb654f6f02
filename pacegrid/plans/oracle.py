"""DuckDB statements, one per registered query key, over the same parquet tables.

Dates that Spark derives from ``as_of`` (Monday, month bounds, day windows)
are computed here with Python's ``datetime`` and written as literals, so the
oracle does not share the Spark date code.
"""

from __future__ import annotations

import datetime as dt

from .context import AS_OF_LOG, AS_OF_PLAN
from .oracle_views import with_views as V

SQL: dict[str, str] = {}


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _lit(d: dt.date) -> str:
    return f"date '{d.isoformat()}'"


LOG = _d(AS_OF_LOG)
PLAN = _d(AS_OF_PLAN)

# --- S --------------------------------------------------------------------
SQL["s7_user_settings"] = V(["user_settings"], "select * from user_settings")

# --- A --------------------------------------------------------------------
SQL["a1_status_rollup"] = V(["users", "problems"], """
select u.id user_id, coalesce(a.total, 0) total, coalesce(a.solved, 0) solved,
  coalesce(a.attempted, 0) attempted, coalesce(a.pending, 0) pending, coalesce(a.skipped, 0) skipped
from users u left join (
  select user_id, count(*)::bigint total,
    sum(case when status='Solved' then 1 else 0 end)::bigint solved,
    sum(case when status='Attempted' then 1 else 0 end)::bigint attempted,
    sum(case when status='Pending' then 1 else 0 end)::bigint pending,
    sum(case when status='Skipped' then 1 else 0 end)::bigint skipped
  from problems group by user_id) a on a.user_id = u.id""")

SQL["a2_category_breakdown"] = V(["problems"], """
select user_id, category, count(*)::bigint total,
  sum(case when status='Solved' then 1 else 0 end)::bigint solved
from problems group by user_id, category""")

SQL["a3_top_skipped_topics"] = V(["problems"], """
select user_id, topic, skipped, rank from (
  select user_id, topic, count(*)::bigint skipped,
    row_number() over (partition by user_id order by count(*) desc, topic) rank
  from problems where status='Skipped' and topic <> '' group by user_id, topic)
where rank <= 3""")

_ws = PLAN - dt.timedelta(days=PLAN.weekday())
_we = _ws + dt.timedelta(days=6)
_ms = PLAN.replace(day=1)
_me = (_ms + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
SQL["a4_plan_progress"] = V(["user_settings", "daily_plan"], f"""
select s.user_id, s.daily_goal, coalesce(a.t, 0) today_solved,
  case when s.daily_goal <> 0 then least(100, round_even(coalesce(a.t, 0) / s.daily_goal * 100, 0))::bigint
       else 0 end today_pct,
  coalesce(a.w, 0) week_solved, s.daily_goal * 7 week_target,
  coalesce(a.m, 0) month_solved, s.daily_goal * {_me.day} month_target
from user_settings s left join (
  select user_id,
    count(*) filter (where plan_date = {_lit(PLAN)})::bigint t,
    count(*) filter (where plan_date between {_lit(_ws)} and {_lit(_we)})::bigint w,
    count(*) filter (where plan_date between {_lit(_ms)} and {_lit(_me)})::bigint m
  from daily_plan where status = 'Solved' group by user_id) a on a.user_id = s.user_id""")

_COVER = """
pc as (select user_id, category, count(*) total, count(*) filter (where status='Solved') solved
       from problems group by user_id, category),
pu as (select user_id, sum(total)::bigint total, sum(solved)::bigint solved, count(*)::bigint cats_total,
              count(*) filter (where solved > 0)::bigint cats_with_solved from pc group by user_id),
cov as (select u.id user_id, coalesce(pu.total, 0) total, coalesce(pu.solved, 0) solved,
          coalesce(pu.cats_total, 0) cats_total, coalesce(pu.cats_with_solved, 0) cats_with_solved
        from users u left join pu on pu.user_id = u.id)"""

SQL["a5_category_coverage"] = V(["users", "problems"], f"""
, {_COVER.strip()}
select *, round_even(cats_with_solved / (case when cats_total > 0 then cats_total else 1 end) * 100, 0)::bigint
  coverage_pct from cov""").replace("\n, pc as", ",\npc as")

# Streak written as "last break day": the latest day before as_of that is not
# a good day, among yesterday and the days just before each good day.
_y = LOG - dt.timedelta(days=1)
_STREAK = f"""
good as (select distinct user_id, log_date from daily_log
         where problems_solved >= 1 and log_date < {_lit(LOG)} and log_date >= {_lit(LOG - dt.timedelta(days=365))}),
cand as (select user_id, log_date - 1 b from good union select user_id, {_lit(_y)} from good),
brk as (select c.user_id, max(c.b) b from cand c
        left join good g on g.user_id = c.user_id and g.log_date = c.b
        where g.user_id is null group by c.user_id),
st as (select user_id, least(365, {_lit(_y)} - b)::bigint streak from brk)"""


def _fix(sql: str) -> str:
    return sql.replace("\n, ", ",\n", 1)


SQL["a6_readiness"] = _fix(V(["users", "problems", "daily_log"], f"""
, {_COVER.strip()},
{_STREAK.strip()},
b as (select cov.*, coalesce(st.streak, 0) streak,
        case when total > 0 then round_even(solved / total * 100, 0)::bigint else 0 end solved_pct,
        round_even(cats_with_solved / (case when cats_total > 0 then cats_total else 1 end) * 100, 0)::bigint
          coverage_pct
      from cov left join st on st.user_id = cov.user_id)
select user_id, total, solved, solved_pct, coverage_pct, streak,
  least(100, round_even(solved_pct * 0.60::double + coverage_pct * 0.20::double + least(streak, 20), 0))::bigint
    readiness
from b"""))

SQL["a7_pace"] = V(["user_settings", "problems"], f"""
select user_id, placement_deadline, days_left, remaining,
  case when days_left > 0 then round_even(remaining / days_left, 1) else remaining::double end needed_per_day
from (
  select s.user_id, s.placement_deadline,
    greatest(0, s.placement_deadline - {_lit(LOG)})::bigint days_left,
    coalesce(r.remaining, 0)::bigint remaining
  from user_settings s left join (
    select user_id, count(*) filter (where status in ('Pending', 'Attempted')) remaining
    from problems group by user_id) r on r.user_id = s.user_id)""")

SQL["a8_project_completion"] = V(["projects", "milestones"], """
select p.id project_id, p.user_id, coalesce(m.total_ms, 0) total_ms, coalesce(m.done_ms, 0) done_ms,
  case when coalesce(m.total_ms, 0) > 0 then round_even(m.done_ms / m.total_ms * 100, 0)::bigint else 0 end
    completion_pct
from projects p left join (
  select project_id, count(*)::bigint total_ms, count(*) filter (where status = 'Done')::bigint done_ms
  from milestones group by project_id) m on m.project_id = p.id""")

SQL["a9_plan_day_log"] = V(["daily_plan", "user_settings"], """
select c.user_id, c.log_date, c.problems_solved, coalesce(s.daily_goal, 10) problems_target
from (select user_id, plan_date log_date, count(*) filter (where status = 'Solved')::bigint problems_solved
      from daily_plan group by user_id, plan_date) c
left join user_settings s on s.user_id = c.user_id""")

_lws = LOG - dt.timedelta(days=LOG.weekday())
SQL["a10_weekly_summary"] = V(["user_settings", "daily_log"], f"""
select user_id, week_solved, days_studied, week_goal,
  case when week_solved < week_goal * 0.5 then 'behind' when week_solved >= week_goal then 'smashed'
       else 'decent' end band,
  days_studied < 5 low_days
from (
  select s.user_id, coalesce(w.ws, 0)::bigint week_solved, coalesce(w.ds, 0)::bigint days_studied,
    s.daily_goal * 7 week_goal
  from user_settings s left join (
    select user_id, sum(problems_solved) ws, count(*) filter (where problems_solved > 0) ds
    from daily_log where log_date between {_lit(_lws)} and {_lit(LOG)} group by user_id) w
  on w.user_id = s.user_id)""")

SQL["a12_plan_existence"] = V(["problems", "daily_plan"], """
select w.user_id, w.plan_date, coalesce(h.n, 0)::bigint plan_rows, coalesce(h.n, 0) = 0 needs_generation
from (select distinct user_id, scheduled_date plan_date from problems
      where status = 'Pending' and scheduled_date is not null) w
left join (select user_id, plan_date, count(*) n from daily_plan group by user_id, plan_date) h
  on h.user_id = w.user_id and h.plan_date = w.plan_date""")

# --- W --------------------------------------------------------------------
SQL["w1_streak"] = _fix(V(["users", "daily_log"], f"""
, {_STREAK.strip()}
select u.id user_id, coalesce(st.streak, 0)::bigint streak from users u left join st on st.user_id = u.id"""))

SQL["w2_plan_order"] = V(["problems"], """
select user_id, scheduled_date, id, difficulty,
  case difficulty when 'Easy' then 1 when 'Medium' then 2 else 3 end difficulty_rank,
  (row_number() over (partition by user_id, scheduled_date
     order by case difficulty when 'Easy' then 1 when 'Medium' then 2 else 3 end, id) - 1)::integer order_index
from problems where scheduled_date is not null""")

SQL["w3_daily_series"] = V(["users", "user_settings", "daily_log"], f"""
select s.user_id, d.log_date, strftime(d.log_date, '%d %b') label,
  coalesce(l.problems_solved, 0)::bigint solved, coalesce(l.problems_target, s.daily_goal)::bigint target
from user_settings s
cross join (select ({_lit(LOG)} - i::integer)::date log_date from range(30) t(i)) d
left join daily_log l on l.user_id = s.user_id and l.log_date = d.log_date""")

SQL["w4_first_wins_articles"] = V(["articles"], """
select seq, source, url, title, score, tag_hint from (
  select *, row_number() over (partition by lower(substring(title, 1, 50)) order by seq) rn from articles)
where rn = 1""")

# --- F --------------------------------------------------------------------
_RANK = "case difficulty when 'Easy' then 1 when 'Medium' then 2 else 3 end"
SQL["f1_problem_search"] = V(["problems"], f"""
select *, {_RANK} difficulty_rank from problems
where lower(category) = lower('economy')
  and (lower(name) like lower('%ring%') or lower(topic) like lower('%ring%') or lower(category) like lower('%ring%'))""")

SQL["f2_topic_view"] = V(["users", "problems", "algorithms"], """
select u.id user_id, coalesce(a.total, 0)::bigint total, coalesce(a.solved, 0)::bigint solved,
  f.id algorithm_id, f.name algorithm_name, f.pattern algorithm_pattern
from users u
left join (select user_id, count(*) total, count(*) filter (where status = 'Solved') solved from problems
           where lower(topic) like '%widget%' or lower(category) like '%widget%' or lower(name) like '%widget%'
           group by user_id) a on a.user_id = u.id
left join (select * from algorithms where lower(name) like '%widget%' or lower(pattern) like '%widget%'
           order by id limit 1) f on true""")

SQL["f3_catalog_search"] = V(["algorithms"], """
select * from algorithms
where lower(name) like '%anvil%' or lower(pattern) like '%anvil%' or lower(description) like '%anvil%'""")

SQL["f4_distinct_topics"] = V(["problems"], "select distinct user_id, topic from problems where topic <> ''")

SQL["f5_problems_in_range"] = V(["problems"], """
select * from problems where scheduled_date between date '1996-01-01' and date '1996-03-31'""")

SQL["f6_owned_milestones"] = V(["projects", "milestones"], """
select m.*, p.user_id from milestones m join projects p on p.id = m.project_id""")

SQL["f7_fill_defaults"] = V(["tasks"], """
select seq, user_id, name, coalesce(topic, '') topic, 'DSA' category, 'Medium' difficulty, 'Custom' platform,
  '' problem_link, '' resource_link, 'Pending' status from tasks""")

# --- J --------------------------------------------------------------------
SQL["j1_plan_with_problems"] = V(["daily_plan", "problems"], """
select dp.user_id, dp.plan_date, dp.order_index, dp.status plan_status, dp.problem_id,
  p.name, p.category, p.topic, p.difficulty, p.platform
from daily_plan dp join problems p on p.id = dp.problem_id""")

SQL["j2_plan_rows_in_category"] = V(["daily_plan", "problems"], """
select * from daily_plan where problem_id in (select id from problems where category = 'SMALL')""")

SQL["j3_unprotected_problems"] = V(["problems", "imports"], """
select p.* from problems p
where not exists (select 1 from imports i
                  where i.protected and i.user_id = p.user_id and i.batch_id = p.import_batch)""")

SQL["j4_new_tasks"] = V(["tasks", "problems"], """
select t.* from tasks t
where not exists (select 1 from problems p
                  where p.user_id = t.user_id and p.name = trim(t.name) and p.topic = coalesce(t.topic, ''))""")

SQL["j5_catalog_seed"] = V(["algorithms"], """
, seed as (
  select n_name name, 'nation' pattern from nation
  union all select p_type, 'type' from part
  union all select p_name, p_brand from part)
select name, pattern, 'catalog' origin from algorithms
union all
select name, min(pattern), 'seed' from seed s
where not exists (select 1 from algorithms a where a.name = s.name)
group by name""")

SQL["j6_yesterday_solved"] = V(["users", "daily_log"], f"""
select u.id user_id, coalesce(l.problems_solved, 0)::bigint yesterday_solved
from users u left join daily_log l on l.user_id = u.id and l.log_date = {_lit(LOG - dt.timedelta(days=1))}""")

# --- L --------------------------------------------------------------------
SQL["l2_recent_logs"] = V(["daily_log"], """
select * from (select *, row_number() over (partition by user_id order by log_date desc) rank from daily_log)
where rank <= 14""")

SQL["l2_recent_imports"] = V(["imports"], """
select * from (select *, row_number() over (partition by user_id order by id desc) rank from imports)
where rank <= 50""")

SQL["l3_milestone_order"] = V(["milestones"], """
select *, dense_rank() over (partition by project_id order by order_index) position from milestones""")

SQL["l4_top_articles"] = V(["articles"], "select * from articles order by score desc, seq limit 9")

SQL["l5_source_caps"] = V(["articles"], """
select * from (select *, row_number() over (partition by source order by seq) rank from articles)
where rank <= 5""")

SQL["l6_heads"] = """
select doc_id, substring(text, 1, 120) head,
  case when len(w) > 12 then array_to_string(w[1:12], ' ') else text end topic
from (select doc_id, text,
        string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') w
      from documents)"""

# --- I --------------------------------------------------------------------
_BATCH = "tasks.xlsx_20240120000000"
_T = """
, t as (select seq, user_id, trim(coalesce(name, '')) name, coalesce(topic, '') topic,
          coalesce(category, 'DSA') category, null::date scheduled_date, 'Medium' difficulty, 'Custom' platform,
          '' problem_link, '' resource_link, 'Pending' status from tasks),
firsts as (select * exclude (rn) from (
             select *, row_number() over (partition by user_id, name, topic order by seq) rn
             from t where name <> '') where rn = 1),
ok as (select f.* from firsts f
       where not exists (select 1 from problems p where p.user_id = f.user_id and p.name = f.name
                         and p.topic = f.topic)),
tot as (select user_id,
          count(*) filter (where name <> '' and seq in (select seq from ok)) imported,
          count(*) filter (where name <> '' and seq not in (select seq from ok)) skipped
        from t group by user_id)"""

SQL["i1_import_add"] = V(["tasks", "problems"], f"""
{_T}
select *, '{_BATCH}' import_batch from ok""")

# the same tasks as JSON requests, read back in their order and imported
SQL["s3_to_i1"] = V(["tasks", "problems"], f"""
{_T}
select * exclude (seq), '{_BATCH}' import_batch from ok""")

SQL["a11_import_totals"] = V(["tasks", "problems"], f"""
{_T}
select * from tot""")

_FIELDS = "user_id, name, category, topic, difficulty, platform, problem_link, resource_link, scheduled_date, status"
SQL["i2_import_replace"] = V(["tasks", "problems", "imports"], f"""
{_T},
importers as (select distinct user_id from t where name <> ''),
prot as (select distinct user_id, batch_id from imports where protected)
select p.* exclude (id, _keep), 'kept' origin from (
  select p.id, {", ".join("p." + f.strip() for f in _FIELDS.split(","))}, p.import_batch, n.user_id is null or r.user_id is not null _keep
  from problems p left join importers n on n.user_id = p.user_id
  left join prot r on r.user_id = p.user_id and r.batch_id = p.import_batch) p where _keep
union all
select {_FIELDS}, '{_BATCH}', 'inserted' from t where name <> ''""")

SQL["i2_plan_left"] = V(["tasks", "problems", "imports", "daily_plan"], f"""
{_T},
importers as (select distinct user_id from t where name <> ''),
prot as (select distinct user_id, batch_id from imports where protected),
removed as (select p.id from problems p join importers n on n.user_id = p.user_id
            left join prot r on r.user_id = p.user_id and r.batch_id = p.import_batch where r.user_id is null)
select d.* from daily_plan d left join removed r on r.id = d.problem_id where r.id is null""")

SQL["i3_ledger_rows"] = V(["tasks", "problems"], f"""
{_T}
select f.user_id, f.filename, {_lit(LOG)} import_date, tot.imported total_imported, '{_BATCH}' batch_id,
  false protected
from (select distinct user_id, concat(category, '.xlsx') filename from tasks) f
join tot on tot.user_id = f.user_id""")

SQL["i4_toggle_protection"] = V(["imports"], """
select id, user_id, filename, batch_id,
  case when filename like '%blue%' then not protected else protected end protected, total_imported, import_date
from imports""")

SQL["i5_delete_range"] = V(["users", "problems", "daily_plan"], """
, gone as (select id from problems where scheduled_date between date '1996-01-01' and date '1996-12-31'),
p as (select user_id, count(*) n from problems where id not in (select id from gone) group by user_id),
pl as (select user_id, count(*) n from daily_plan where problem_id not in (select id from gone) group by user_id)
select u.id user_id, coalesce(p.n, 0) problems_left, coalesce(pl.n, 0) plan_left
from users u left join p on p.user_id = u.id left join pl on pl.user_id = u.id""")


def _batch_sql(batch: str) -> str:
    return V(["users", "problems", "daily_plan", "imports"], f"""
, refused as (select distinct user_id from imports where protected and batch_id = '{batch}'),
gone as (select id from problems where import_batch = '{batch}'
         and user_id not in (select user_id from refused)),
p as (select user_id, count(*) n from problems where id not in (select id from gone) group by user_id),
pl as (select user_id, count(*) n from daily_plan where problem_id not in (select id from gone) group by user_id)
select u.id user_id, coalesce(p.n, 0) problems_left, coalesce(pl.n, 0) plan_left,
  u.id in (select user_id from refused) refused
from users u left join p on p.user_id = u.id left join pl on pl.user_id = u.id""")


SQL["i5_delete_batch"] = _batch_sql("batch_7")
SQL["i5_refuse_batch"] = _batch_sql("batch_8")

SQL["i6_clear_imports"] = V(["users", "problems", "daily_plan", "daily_log", "imports"], """
, cu as (select c_custkey user_id from customer where c_mktsegment = 'AUTOMOBILE'),
gone as (select p.id from problems p where p.user_id in (select user_id from cu)
         and not exists (select 1 from imports i where i.protected and i.user_id = p.user_id
                         and i.batch_id = p.import_batch)),
p as (select user_id, count(*) n from problems where id not in (select id from gone) group by user_id),
pl as (select user_id, count(*) n from daily_plan where user_id not in (select user_id from cu) group by user_id),
lg as (select user_id, count(*) n from daily_log where user_id not in (select user_id from cu) group by user_id),
im as (select user_id, count(*) n from imports where user_id not in (select user_id from cu) or protected
       group by user_id)
select u.id user_id, coalesce(p.n, 0) problems_left, coalesce(pl.n, 0) plan_left, coalesce(lg.n, 0) log_left,
  coalesce(im.n, 0) imports_left
from users u left join p on p.user_id = u.id left join pl on pl.user_id = u.id
left join lg on lg.user_id = u.id left join im on im.user_id = u.id""")

SQL["i7_delete_one"] = V(["problems", "daily_plan"], """
select * from daily_plan dp
where not exists (select 1 from problems p where p.status = 'Skipped' and p.difficulty = 'Hard'
                  and p.id = dp.problem_id and p.user_id = dp.user_id)""")

SQL["i8_generate_plans"] = V(["problems"], f"""
select user_id, scheduled_date plan_date, id problem_id,
  (row_number() over (partition by user_id, scheduled_date order by {_RANK}, id) - 1)::integer order_index,
  'Pending' status
from problems where status = 'Pending' and scheduled_date is not null""")

_EV = """
, ev as (select e.* from status_events e
         where exists (select 1 from problems p where p.id = e.problem_id and p.user_id = e.user_id)),
perday as (select user_id, problem_id, plan_date, status from (
             select *, row_number() over (partition by user_id, problem_id, plan_date
                                          order by ts desc, status desc) rn from ev) where rn = 1),
perprob as (select problem_id, status from (
             select *, row_number() over (partition by problem_id order by ts desc, status desc) rn from ev)
            where rn = 1),
newplan as (select dp.user_id, dp.plan_date, dp.problem_id, dp.order_index,
              coalesce(d.status, dp.status) status
            from daily_plan dp left join perday d on d.user_id = dp.user_id and d.problem_id = dp.problem_id
              and d.plan_date = dp.plan_date),
touched as (select distinct user_id, plan_date log_date from ev),
solved as (select user_id, plan_date log_date, count(*) n from newplan where status = 'Solved'
           group by user_id, plan_date),
counts as (select t.user_id, t.log_date, coalesce(s.n, 0)::bigint ps, coalesce(us.daily_goal, 10)::bigint pt
           from touched t left join solved s on s.user_id = t.user_id and s.log_date = t.log_date
           left join user_settings us on us.user_id = t.user_id)"""

SQL["i9_status_log"] = V(["problems", "daily_plan", "daily_log", "user_settings", "status_events"], f"""
{_EV}
select coalesce(l.user_id, c.user_id) user_id, coalesce(l.log_date, c.log_date) log_date,
  coalesce(c.ps, l.problems_solved)::bigint problems_solved,
  coalesce(l.problems_attempted, 0)::bigint problems_attempted,
  coalesce(l.problems_skipped, 0)::bigint problems_skipped,
  coalesce(c.pt, l.problems_target)::bigint problems_target
from daily_log l full outer join counts c on c.user_id = l.user_id and c.log_date = l.log_date""")

SQL["i9_problem_status"] = V(["problems", "daily_plan", "daily_log", "user_settings", "status_events"], f"""
{_EV}
select p.id, p.user_id, coalesce(pp.status, p.status) status
from problems p left join perprob pp on pp.problem_id = p.id""")

SQL["i9_plan"] = V(["problems", "daily_plan", "daily_log", "user_settings", "status_events"], f"""
{_EV}
select * from newplan""")

SQL["i10_activity_upsert"] = V(["daily_log", "activity", "user_settings"], """
, a as (select a.user_id, a.log_date, a.problems_solved, 0::bigint problems_attempted, 0::bigint problems_skipped,
          coalesce(us.daily_goal, 10)::bigint problems_target, (a.problems_solved * 0.5)::double study_hours,
          case when a.problems_solved > 1 then 'good' else 'tired' end mood,
          concat('views ', cast(a.problems_solved as varchar)) notes
        from activity a left join user_settings us on us.user_id = a.user_id)
select user_id, log_date, problems_solved, problems_attempted, problems_skipped, problems_target,
  0.0::double study_hours, '' mood, '' notes
from daily_log l
where not exists (select 1 from a where a.user_id = l.user_id and a.log_date = l.log_date)
union all select * from a""")

SQL["i11_milestone_completion"] = V(["projects", "milestones"], """
, m2 as (select project_id, order_index, deadline,
           case when (project_id, order_index) in (select project_id, order_index from milestones
                                                  where deadline <= date '1995-06-30') then 'Done'
                else status end status
         from milestones)
select p.id project_id, p.user_id, coalesce(m.total_ms, 0) total_ms, coalesce(m.done_ms, 0) done_ms,
  case when coalesce(m.total_ms, 0) > 0 then round_even(m.done_ms / m.total_ms * 100, 0)::bigint else 0 end
    completion_pct
from projects p left join (
  select project_id, count(*)::bigint total_ms, count(*) filter (where status = 'Done')::bigint done_ms
  from m2 group by project_id) m on m.project_id = p.id""")

SQL["i11_projects"] = V(["projects"], """
select id, user_id, case when year(target_date) = 1995 then concat('renamed ', cast(id as varchar)) else name end name,
  case when year(target_date) = 1995 then target_date + 30 else target_date end target_date
from projects
union all
select id + 10000000000, user_id, concat('new ', cast(id as varchar)), target_date
from projects where year(target_date) = 1997""")

SQL["i11_milestones"] = V(["projects", "milestones"], """
select project_id, order_index, deadline,
  case when (project_id, order_index) in (select project_id, order_index from milestones
                                          where year(deadline) = 1995) then 'Done' else status end status
from milestones
where (project_id, order_index) not in (select project_id, order_index from milestones
                                        where deadline < date '1993-01-01')
union all
select id, 100, target_date + 60, 'Pending' from projects where year(target_date) = 1997""")

SQL["i12_settings_upsert"] = V(["settings"], """
, ch as (select c_custkey user_id, 'daily_goal' key, '12' value from customer where c_acctbal > 5000)
select * from settings s
where not exists (select 1 from ch where ch.user_id = s.user_id and ch.key = s.key)
union all select * from ch""")

SQL["i13_mastery_upsert"] = V(["problems"], """
, old as (select user_id, id % 200 algorithm_id, 'Learning' mastery, 0::bigint solved_problems
          from problems where status = 'Attempted' group by user_id, id % 200),
ch as (select user_id, id % 200 algorithm_id, 'Practicing' mastery, count(*)::bigint solved_problems
       from problems where status = 'Solved' group by user_id, id % 200)
select * from old o
where not exists (select 1 from ch where ch.user_id = o.user_id and ch.algorithm_id = o.algorithm_id)
union all select * from ch""")

# --- N --------------------------------------------------------------------
from ..functions import rules as _RU  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(expr: str, rules, default: str) -> str:
    """``CASE`` of an ordered (keywords, label) rule table on a lower-cased expression."""
    arms = " ".join(f"when {' or '.join(f'contains({expr}, {_q(k)})' for k in keys)} then {_q(label)}"
                    for keys, label in rules)
    return f"(case {arms} else {default} end)"


def _sheet_case(expr: str, default: str = "null") -> str:
    return _case(expr, [([k], v) for k, v in _RU.SHEET_CATEGORY_RULES], default)


_BLANK = "({v} is null or lower(trim({v})) in ('', 'nan', 'none'))"


def _blank(v: str) -> str:
    return _BLANK.format(v=v)


def _clean(v: str) -> str:
    return f"(case when {_blank(v)} then '' else trim({v}) end)"


def _repair(v: str) -> str:
    return (f"(case when {v} <> '' and not starts_with({v}, 'http') and contains({v}, '.') "
            f"then 'https://' || ltrim({v}, '/') else {v} end)")


def _platform(v: str) -> str:
    return _case(f"lower(coalesce({v}, ''))", _RU.PLATFORM_RULES, "'Custom'")


def _parse(v: str) -> str:
    fmts = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%d/%m/%Y", "%B %d %Y", "%b %d %Y", "%d %B %Y",
            "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y", "%d %b %Y", "%m/%d/%y", "%Y%m%d",
            "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%g"]
    return "coalesce(" + ", ".join(f"try_strptime(trim({v}), '{f}')" for f in fmts) + ")::date"


_ALIASES = ", ".join(f"({_q(f)}, {i}, {_q(a)})" for f, al in _RU.HEADER_ALIASES for i, a in enumerate(al))
_SHEETS = f"""
, hd as (select distinct source_file, sheet, col_no, header, trim(coalesce(header, '')) h,
           lower(trim(coalesce(header, ''))) h_low from sheet_cells),
al as (select * from (values {_ALIASES}) t(field, alias_rank, alias)),
hm as (select source_file, sheet, field, col_no, header from (
         select hd.source_file, hd.sheet, al.field, hd.col_no, hd.h header,
           row_number() over (partition by hd.source_file, hd.sheet, al.field order by al.alias_rank, hd.col_no desc) rn
         from hd join al on hd.h_low = al.alias) where rn = 1),
lay as (
  select s.source_file, s.sheet,
    case when nm.source_file is not null then 'A' when tc.c is not null then 'B'
         when dh.h is not null then 'C' else 'D' end layout,
    coalesce({_sheet_case("lower(s.sheet)")}, hc.cat, 'DSA') category,
    tc.c topic_col, lc.c link_col, pc.c priority_col, dh.h day_header
  from (select distinct source_file, sheet from hd) s
  left join (select distinct source_file, sheet from hm where field = 'name') nm
    on nm.source_file = s.source_file and nm.sheet = s.sheet
  left join (select source_file, sheet, min(col_no) c from hd where h_low in ('topic', 'subject')
             group by source_file, sheet) tc on tc.source_file = s.source_file and tc.sheet = s.sheet
  left join (select source_file, sheet, min(col_no) c from hd
             where h_low in ('resource', 'resource link', 'ref', 'link', 'url')
             group by source_file, sheet) lc on lc.source_file = s.source_file and lc.sheet = s.sheet
  left join (select source_file, sheet, min(col_no) c from hd
             where h_low in ('priority', 'difficulty', 'level', 'status')
             group by source_file, sheet) pc on pc.source_file = s.source_file and pc.sheet = s.sheet
  left join (select source_file, sheet, arg_min(h, col_no) h from hd where h_low = 'day' or starts_with(h_low, 'day ')
             group by source_file, sheet) dh on dh.source_file = s.source_file and dh.sheet = s.sheet
  left join (select source_file, sheet, arg_min(cat, col_no) cat from (
               select *, {_case("h_low", _RU.HEADER_CATEGORY_RULES, "null")} cat from hd)
             where cat is not null group by source_file, sheet) hc
    on hc.source_file = s.source_file and hc.sheet = s.sheet),
a0 as (
  select c.source_file, c.sheet, c.row_no,
    max(case when m.field = 'name' then c.value end) v_name,
    max(case when m.field = 'topic' then c.value end) v_topic,
    max(case when m.field = 'difficulty' then c.value end) v_diff,
    max(case when m.field = 'problem_link' then c.value end) v_plink,
    max(case when m.field = 'resource_link' then c.value end) v_rlink,
    max(case when m.field = 'date' then c.value end) v_date,
    max(case when m.field = 'platform' then c.value end) v_platform,
    any_value(l.category) category
  from sheet_cells c
  join hm m on m.source_file = c.source_file and m.sheet = c.sheet and m.col_no = c.col_no
  join lay l on l.source_file = c.source_file and l.sheet = c.sheet and l.layout = 'A'
  group by c.source_file, c.sheet, c.row_no),
a1 as (select *, {_repair(_clean("v_plink"))} plink, {_repair(_clean("v_rlink"))} rlink,
         {_clean("v_platform")} plat, lower({_clean("v_diff")}) dl from a0
       where not {_blank("trim(coalesce(v_name, ''))")}),
a_rows as (
  select source_file, sheet, row_no, null::integer col_no, trim(coalesce(v_name, '')) name, category,
    {_clean("v_topic")} topic,
    case when dl in ('easy', 'medium', 'hard') then upper(dl[1]) || dl[2:]
         when dl in ('must', 'high', 'critical') then 'High' else 'Medium' end difficulty,
    case when plat <> '' then plat else {_platform("plink")} end platform,
    plink problem_link, rlink resource_link,
    case when {_blank("v_date")} then null::date else {_parse("v_date")} end scheduled_date
  from a1),
b0 as (
  select c.source_file, c.sheet, c.row_no,
    max(case when c.col_no = l.topic_col then c.value end) v_t,
    max(case when c.col_no = l.link_col then c.value end) v_l,
    max(case when c.col_no = l.priority_col then c.value end) v_p,
    any_value(l.category) category
  from sheet_cells c join lay l on l.source_file = c.source_file and l.sheet = c.sheet and l.layout = 'B'
  group by c.source_file, c.sheet, c.row_no),
b_rows as (
  select source_file, sheet, row_no, null::integer col_no, trim(coalesce(v_t, '')) name, category,
    trim(coalesce(v_t, '')) topic,
    case when lower(trim(coalesce(v_p, ''))) in ('must', 'high', 'critical') then 'High'
         when lower(trim(coalesce(v_p, ''))) in ('optional', 'low') then 'Low' else 'Medium' end difficulty,
    {_platform(_repair(_clean("v_l")))} platform,
    {_repair(_clean("v_l"))} problem_link, {_repair(_clean("v_l"))} resource_link, null::date scheduled_date
  from b0 where not {_blank("trim(coalesce(v_t, ''))")}),
c_day as (
  select c.source_file, c.sheet, c.row_no, arg_min(c.value, c.col_no) dv
  from sheet_cells c join lay l on l.source_file = c.source_file and l.sheet = c.sheet and l.layout = 'C'
  where trim(coalesce(c.header, '')) = l.day_header group by c.source_file, c.sheet, c.row_no),
c_rows as (
  select c.source_file, c.sheet, c.row_no, c.col_no::integer col_no, trim(c.value) name,
    coalesce({_case("lower(trim(coalesce(c.header, '')))", _RU.DAY_GRID_HEADER_RULES, "null")},
             {_sheet_case("lower(trim(coalesce(c.header, '')))")}, 'DSA') category,
    trim(coalesce(c.header, '')) topic, 'Medium' difficulty, 'Custom' platform,
    '' problem_link, '' resource_link, null::date scheduled_date
  from sheet_cells c
  join lay l on l.source_file = c.source_file and l.sheet = c.sheet and l.layout = 'C'
  join c_day d on d.source_file = c.source_file and d.sheet = c.sheet and d.row_no = c.row_no
  where trim(coalesce(c.header, '')) <> l.day_header and not {_blank("c.value")} and not {_blank("d.dv")}),
d0 as (
  select c.source_file, c.sheet, c.row_no, list(trim(c.value) order by c.col_no) vals, any_value(l.category) category
  from sheet_cells c join lay l on l.source_file = c.source_file and l.sheet = c.sheet and l.layout = 'D'
  where not {_blank("c.value")} group by c.source_file, c.sheet, c.row_no),
d_rows as (
  select source_file, sheet, row_no, null::integer col_no, vals[1] name, category,
    coalesce(vals[2], '') topic, 'Medium' difficulty,
    {_platform("coalesce(list_filter(vals, lambda x: starts_with(x, 'http'))[1], '')")} platform,
    coalesce(list_filter(vals, lambda x: starts_with(x, 'http'))[1], '') problem_link,
    coalesce(list_filter(vals, lambda x: starts_with(x, 'http'))[1], '') resource_link, null::date scheduled_date
  from d0),
tasks_out as (
  select *, 'Pending' status from a_rows union all select *, 'Pending' from b_rows
  union all select *, 'Pending' from c_rows union all select *, 'Pending' from d_rows)"""

SQL["n1_header_map"] = V(["sheet_cells"], _SHEETS + "\nselect * from hm")
SQL["n2_sheet_layouts"] = V(["sheet_cells"], _SHEETS + "\nselect * from lay")
SQL["n3_normalise_sheets"] = V(["sheet_cells"], _SHEETS + "\nselect * from tasks_out")
SQL["n13_upload_summary"] = V(["sheet_cells"], _SHEETS + """
select s.source_file, s.sheets, coalesce(t.n, 0)::bigint tasks from (
  select source_file, string_agg(source_file || '::' || sheet, ',' order by source_file || '::' || sheet) sheets
  from (select distinct source_file, sheet from sheet_cells) group by source_file) s
left join (select source_file, count(*) n from tasks_out group by source_file) t on t.source_file = s.source_file""")

_RAW = "(case when page_id % 2 = 0 then url else regexp_replace(url, '^https?://', '') end)"
SQL["n8_link_platforms"] = f"""
select page_id, {_repair(_clean(_RAW))} link, {_platform(_repair(_clean(_RAW)))} platform from pages"""

SQL["n10_parse_dates"] = f"""
select o_orderkey, text, {_parse("text")} parsed from (
  select o_orderkey, case o_orderkey % 5
      when 0 then strftime(o_orderdate::date, '%Y-%m-%d') when 1 then strftime(o_orderdate::date, '%m/%d/%Y')
      when 2 then strftime(o_orderdate::date, '%d/%m/%Y') when 3 then strftime(o_orderdate::date, '%B %-d %Y')
      else 'Day ' || cast(day(o_orderdate) as varchar) end text
  from orders)"""

SQL["n11_difficulty_words"] = """
select o_orderkey, word,
  case when word in ('easy', 'medium', 'hard') then upper(word[1]) || word[2:]
       when word in ('must', 'high', 'critical') then 'High' else 'Medium' end named_layout,
  case when word in ('must', 'high', 'critical') then 'High' when word in ('optional', 'low') then 'Low'
       else 'Medium' end topic_list_layout
from (select o_orderkey, lower(regexp_replace(o_orderpriority, '^[0-9]+-', '')) word from orders)"""

# --- T --------------------------------------------------------------------


def _any(expr: str, keys) -> str:
    return "(" + " or ".join(f"contains({expr}, {_q(k)})" for k in keys) + ")"


_REL = _any("lower(title)", _RU.RELEVANCE_KEYWORDS)
_TAG = _case("lower(title)", _RU.TAG_RULES, "'Tech'")
SQL["t1_relevance"] = V(["articles"], f"select seq, {_REL} relevant from articles")
SQL["t2_topic_tags"] = V(["articles"], f"select seq, {_TAG} tag from articles")
SQL["t2_tag_counts"] = V(["articles"], f"""
select tag, count(*) items, count(*) filter (where relevant) relevant_items
from (select {_TAG} tag, {_REL} relevant from articles) group by tag""")

_FB = ", ".join(f"({i + 1}, {_q(t)}, {_q(u)}, {_q(s)}, {_q(tg)}, {sc})"
                for i, (t, u, s, tg, sc) in enumerate(_RU.FALLBACK_ARTICLES))
_KCOLS = "run, source, kind, kind_rank, pos, stitle, url, tag, score, block"
def _news_sql(limit: int) -> str:
    return V(["articles"], f"""
, it as (select *, cast(regexp_extract(source, '(\\d+)$', 1) as integer) k from articles
         where regexp_matches(source, '\\d+$')),
it2 as (select *, row_number() over (partition by source, seq // 600 order by seq) pos,
          cast(seq // 600 as varchar) || '.' || cast(k // 5 as varchar) run,
          case k % 5 when 0 then 'scored' when 1 then 'tagged' when 2 then 'ai_feed' when 3 then 'trending'
               else 'tutorials' end kind, k % 5 + 1 kind_rank from it),
g as (select *, {_REL} rel, {_TAG} ctag from it2
      where pos <= case kind when 'scored' then 30 when 'tagged' then 25 when 'ai_feed' then 5
                             when 'trending' then 4 else 6 end),
kept as (select run, source, kind, kind_rank, pos, substring(title, 1, 120) stitle, url,
           case kind when 'tagged' then (case when coalesce(tag_hint, '') <> '' then upper(tag_hint) else ctag end)
                when 'ai_feed' then 'AI/ML' when 'trending' then 'Open Source' else ctag end tag,
           (case when kind in ('scored', 'tagged') then score else 0 end)::bigint score, (pos - 1) // 5 block
         from g
         where case kind when 'scored' then coalesce(url, '') <> '' and score > 20 and rel
                         when 'tagged' then coalesce(title, '') <> '' and coalesce(url, '') <> '' and rel
                         when 'tutorials' then coalesce(title, '') <> '' and coalesce(url, '') <> '' and rel
                         else coalesce(title, '') <> '' and coalesce(url, '') <> '' end),
hn as (select {_KCOLS} from (select *, row_number() over (partition by run order by pos) n
                                  from kept where kind = 'scored') where n <= 12),
hn_n as (select run, count(*) c from hn group by run),
tb as (select run, block, count(*) bn from kept where kind = 'tagged' group by run, block),
tb2 as (select tb.run, tb.block, coalesce(hn_n.c, 0) + coalesce(sum(bn) over (partition by tb.run order by tb.block
          rows between unbounded preceding and 1 preceding), 0) before
        from tb left join hn_n on hn_n.run = tb.run),
k2 as (select {_KCOLS} from hn
       union all select {", ".join("k." + c for c in _KCOLS.split(", "))} from kept k
         join tb2 on tb2.run = k.run and tb2.block = k.block
         where k.kind = 'tagged' and (k.block = 0 or tb2.before < 14)
       union all select {_KCOLS} from kept where kind in ('ai_feed', 'trending', 'tutorials')),
u as (select * from (select *, row_number() over (partition by run, lower(substring(stitle, 1, 50))
                                                  order by kind_rank, pos) f from k2) where f = 1),
top as (select * from (select run, row_number() over (partition by run order by score desc, kind_rank, pos) rank,
                         stitle title, url, source, tag, score from u) where rank <= {limit}),
fb as (select * from (values {_FB}) t(rank, title, url, source, tag, score))
select * from top
union all
select r.run, fb.rank::bigint, fb.title, fb.url, fb.source, fb.tag, fb.score::bigint
from (select distinct run from it2 where run not in (select run from top)) r, fb where fb.rank <= {limit}""")


SQL["t3_news_digest"] = _news_sql(9)
SQL["s4_to_t3"] = _news_sql(9)  # the same items, landed as JSON and read back
SQL["s4_rss"] = V(["articles"], """
select url, trim(regexp_replace(substring(title, 1, 120), '\\s+', ' ', 'g')) title, 'rss' source, 0::bigint score, null::varchar tag_hint
from articles""")

_PERS = _any("lower(message)", _RU.PERSONAL_SIGNALS)
_RES = _any("lower(message)", _RU.RESOURCE_KEYWORDS)
_WORDS = "string_split_regex(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), '\\s+')"
_TOPIC = f"(case when len({_WORDS}) > 12 then array_to_string({_WORDS}[1:12], ' ') else message end)"
SQL["t5_personal_intent"] = V(["prompts"], f"select conv_id, turn, {_PERS} personal from prompts")
SQL["t6_resource_topic"] = V(["prompts"], f"""
select conv_id, turn, {_RES} wants_resources, {_TOPIC} topic from prompts""")

_GEN = " || chr(10) || ".join(
    "'" + tpl.replace("{q}", "' || replace(topic, ' ', '+') || '") + "'" for tpl in _RU.SEARCH_LINK_TEMPLATES)
_LINKS = ("(case " + " ".join(f"when contains(lower(topic), {_q(k)}) then {_q(chr(10).join(v[:4]))}"
                               for k, v in _RU.FALLBACK_RESOURCES) + f" else {_GEN} end)")
SQL["t7_resource_links"] = V(["prompts"], f"""
select conv_id, turn, {_LINKS} links from (select conv_id, turn, {_TOPIC} topic from prompts where {_RES})""")

_ROUTE = _case("lower(message)", _RU.ROUTER_RULES, "'default'")
SQL["t8_route"] = V(["prompts"], f"select conv_id, turn, {_ROUTE} intent from prompts")
SQL["t8_route_counts"] = V(["prompts"], f"select {_ROUTE} intent, count(*) messages from prompts group by 1")

SQL["s10_latest_feedback"] = V(["feedback"], """
select user_id, feedback_date, feedback_type, content, model_used, id from (
  select *, row_number() over (partition by user_id, feedback_date, feedback_type order by id desc) rn
  from feedback) where rn = 1""")

# --- T9-T12 ---------------------------------------------------------------
_PROFILE = """
pc2 as (select user_id, category, count(*) total, count(*) filter (where status = 'Solved') solved,
          count(*) filter (where status = 'Attempted') attempted, count(*) filter (where status = 'Pending') pending,
          count(*) filter (where status = 'Skipped') skipped
        from problems group by user_id, category),
pu2 as (select user_id, sum(total) total, sum(solved) solved, sum(attempted) attempted, sum(pending) pending,
          sum(skipped) skipped, count(*) cats_total, count(*) filter (where solved > 0) cats_with_solved,
          string_agg(category || ': ' || cast(solved as varchar) || '/' || cast(total as varchar), ', '
                     order by category) cat_breakdown
        from pc2 group by user_id),
prof as (select u.id user_id, coalesce(total, 0)::bigint total, coalesce(solved, 0)::bigint solved,
           coalesce(attempted, 0)::bigint attempted, coalesce(pending, 0)::bigint pending,
           coalesce(skipped, 0)::bigint skipped, coalesce(cats_total, 0) cats_total,
           coalesce(cats_with_solved, 0) cats_with_solved, coalesce(cat_breakdown, 'None') cat_breakdown
         from users u left join pu2 on pu2.user_id = u.id)"""

SQL["t9_status_context"] = _fix(V(["users", "problems", "daily_log", "user_settings"], f"""
, {_PROFILE.strip()},
{_STREAK.strip()},
b as (select prof.*, s.name, s.placement_deadline, s.daily_goal,
        greatest(0, s.placement_deadline - {_lit(LOG)})::bigint days_left,
        coalesce(l.problems_solved, 0)::bigint solved_today, coalesce(st.streak, 0)::bigint streak,
        case when total > 0 then round_even(solved / total * 100, 0)::bigint else 0 end solved_pct,
        round_even(cats_with_solved / (case when cats_total > 0 then cats_total else 1 end) * 100, 0)::bigint cov,
        pending + attempted remaining
      from prof left join user_settings s on s.user_id = prof.user_id
      left join st on st.user_id = prof.user_id
      left join daily_log l on l.user_id = prof.user_id and l.log_date = {_lit(LOG)})
select user_id, name, placement_deadline, days_left, daily_goal, solved_today, streak,
  least(100, round_even(solved_pct * 0.60::double + cov * 0.20::double + least(streak, 20), 0))::bigint readiness,
  total, solved, solved_pct, pending, attempted, skipped, cat_breakdown,
  case when days_left > 0 then round_even(remaining / days_left, 1) else remaining::double end needed_per_day,
  remaining
from b"""))

SQL["t10_daily_report"] = V(["users", "problems", "daily_log", "daily_plan", "user_settings"], f"""
, tl as (select dp.user_id, count(*) tasks,
           string_agg(case dp.status when 'Solved' then '✅' when 'Skipped' then '⏭️' else '🔲' end
                      || ' **' || p.name || '** [' || p.category || ' – ' || p.difficulty || ']', chr(10)
                      order by dp.order_index, dp.problem_id,
                      case dp.status when 'Solved' then '✅' when 'Skipped' then '⏭️' else '🔲' end
                      || ' **' || p.name || '** [' || p.category || ' – ' || p.difficulty || ']') task_lines
         from daily_plan dp join problems p on p.id = dp.problem_id
         where dp.plan_date = {_lit(PLAN)} group by dp.user_id),
pr as (select user_id, count(*) filter (where status = 'Solved') solved,
         count(*) filter (where status = 'Pending') pending from problems group by user_id)
select u.id user_id, coalesce(pr.solved, 0)::bigint solved, coalesce(pr.pending, 0)::bigint pending,
  (s.placement_deadline - {_lit(PLAN)})::bigint days_left, coalesce(l.problems_solved, 0)::bigint solved_today,
  s.daily_goal goal,
  case when coalesce(l.problems_solved, 0) = 0 then 'zero' when coalesce(l.problems_solved, 0) < s.daily_goal
       then 'behind' else 'done' end band,
  coalesce(tl.tasks, 0)::bigint tasks,
  coalesce(tl.task_lines, '- No tasks scheduled. Import an Excel sheet to get started.') task_lines
from users u left join pr on pr.user_id = u.id left join user_settings s on s.user_id = u.id
left join daily_log l on l.user_id = u.id and l.log_date = {_lit(PLAN)}
left join tl on tl.user_id = u.id""")

SQL["t11_suggestion_report"] = V(["users", "problems", "user_settings"], f"""
, pr as (select user_id, count(*) total, count(*) filter (where status = 'Solved') solved
         from problems group by user_id),
top3 as (select user_id, topic, skipped, rank from (
           select user_id, topic, count(*) skipped,
             row_number() over (partition by user_id order by count(*) desc, topic) rank
           from problems where status = 'Skipped' and topic <> '' group by user_id, topic) where rank <= 3),
weak as (select user_id, string_agg('**' || topic || '** (' || cast(skipped as varchar) || ' skipped)', ', '
                                    order by rank) weak_topics from top3 group by user_id)
select u.id user_id, (s.placement_deadline - {_lit(LOG)})::bigint days_left,
  coalesce(pr.solved, 0)::bigint solved, coalesce(pr.total, 0)::bigint total,
  case when coalesce(pr.total, 0) <> 0 then round_even(pr.solved / pr.total * 100, 1) else 0.0::double end solved_pct,
  weak.weak_topics
from users u left join pr on pr.user_id = u.id left join user_settings s on s.user_id = u.id
left join weak on weak.user_id = u.id""")

SQL["t12_weekly_report"] = V(["users", "user_settings", "daily_log", "problems"], f"""
select w.*, coalesce(pr.total, 0)::bigint total, coalesce(pr.solved, 0)::bigint solved from (
  select user_id, week_solved, days_studied, week_goal,
    case when week_solved < week_goal * 0.5 then 'behind' when week_solved >= week_goal then 'smashed'
         else 'decent' end band,
    days_studied < 5 low_days
  from (
    select s.user_id, coalesce(w.ws, 0)::bigint week_solved, coalesce(w.ds, 0)::bigint days_studied,
      s.daily_goal * 7 week_goal
    from user_settings s left join (
      select user_id, sum(problems_solved) ws, count(*) filter (where problems_solved > 0) ds
      from daily_log where log_date between {_lit(_lws)} and {_lit(LOG)} group by user_id) w
    on w.user_id = s.user_id)) w
left join (select user_id, count(*) total, count(*) filter (where status = 'Solved') solved
           from problems group by user_id) pr on pr.user_id = w.user_id""")

_LINKS_LINE = ("[NeetCode](https://neetcode.io) | [takeUforward](https://takeuforward.org) | "
               "[IndiaBix](https://www.indiabix.com)")


def _over(key: str, body: str) -> str:
    """``body`` reading the statement of another key as ``r``."""
    return f"select user_id, {body} report from ({SQL[key]}) r"


SQL["t10_daily_text"] = _over("t10_daily_report", f"""concat(
  '### Your Numbers for Today', chr(10), '- **Solved overall:** ', solved, ' | **Pending:** ', pending,
  ' | **Days left:** ', days_left, chr(10), '- **Today:** ', solved_today, '/', goal, ' done', chr(10), chr(10),
  '### Reality Check', chr(10),
  case band when 'zero'
    then concat(' You have solved **0/', goal, '** problems today. Every hour you delay costs you. Start now.')
    when 'behind' then concat(' **', solved_today, '/', goal, '** done. You need **', goal - solved_today,
                              '** more to hit your daily goal.')
    else concat(' Daily goal of ', goal, ' achieved! Strong consistency builds placements.') end,
  chr(10), chr(10), '### Today''s Tasks', chr(10), task_lines, chr(10), chr(10), '### Resources', chr(10),
  '{_LINKS_LINE}', chr(10))""")

SQL["t11_text"] = _over("t11_suggestion_report", """concat(
  '### Priority Study Directives', chr(10), '- **Time left:** ', days_left, ' days | **Solved:** ', solved, '/', total,
  ' (', case when total <> 0 then cast(solved_pct as varchar) else '0' end, '%)', chr(10), chr(10), '### Weak Areas',
  chr(10), case when weak_topics is not null then concat('🚨 Topics you keep skipping: ', weak_topics, chr(10),
                                                         'Spend 2 focused days on these.', chr(10))
                else concat('✅ No heavy skipping pattern. Keep tackling harder problems.', chr(10)) end,
  chr(10), '### Recommended Resources', chr(10),
  '- **DSA:** [NeetCode](https://neetcode.io) | [takeUforward](https://takeuforward.org)', chr(10),
  '- **Aptitude & Verbal:** [IndiaBix](https://www.indiabix.com)', chr(10),
  '- **SQL:** [SQLZoo](https://sqlzoo.net) | [LeetCode SQL 50](https://leetcode.com/studyplan/sql-50/)', chr(10),
  '- **System Design:** [ByteByteGo](https://www.youtube.com/@ByteByteGo)', chr(10))""")

SQL["t12_weekly_text"] = _over("t12_weekly_report", """concat(
  '### Weekly Performance', chr(10), '- **Solved this week:** ', week_solved, '/', week_goal, ' | **Days studied:** ',
  days_studied, '/7 | **Overall:** ', solved, '/', total, chr(10), chr(10), '### Reality Check', chr(10),
  case when low_days then concat(' Only ', days_studied, '/7 days studied. Aim for 6 minimum.')
       else concat(' Good consistency — ', days_studied, '/7 days studied.') end, chr(10),
  case band when 'behind' then concat(' Behind target: ', week_solved, '/', week_goal, '. Increase volume.')
            when 'smashed' then concat(' Target smashed! ', week_solved, '/', week_goal, '.')
            else concat(' Decent: ', week_solved, '/', week_goal, '. Push harder next week.') end, chr(10), chr(10),
  '### Next Week Directives', chr(10), '1. Tackle skipped problems first.', chr(10),
  '2. [NeetCode Roadmap](https://neetcode.io) for DSA structure.', chr(10),
  '3. [IndiaBix](https://www.indiabix.com) for Aptitude + Verbal.', chr(10))""")

# --- S5/S6/S8, X ------------------------------------------------------------
SQL["s6_resource_json"] = """
select conv_id, turn, json_extract_string(b, '$.youtube') youtube, json_extract_string(b, '$.article') article,
  json_extract_string(b, '$.practice') practice
from (select conv_id, turn, nullif(regexp_extract(text, '(?s)(\\{.*?\\})', 1), '') b
      from conversations where role = 'assistant')"""

SQL["s8_rows_json"] = V(["users"], """
select id, to_json({'id': id, 'username': username})::varchar json from users""")

SQL["x3_daily_solved"] = V(["status_events"], """
select user_id, cast(date_trunc('day', ts) as date) window_start,
  cast(date_trunc('day', ts) as date) + 1 window_end, count(*)::bigint solved
from status_events where status = 'Solved' group by all""")

SQL["x3_weekly_solved"] = V(["status_events"], """
select user_id, cast(date_trunc('week', ts) as date) window_start,
  cast(date_trunc('week', ts) as date) + 7 window_end, count(*)::bigint solved
from status_events where status = 'Solved' group by all""")

SQL["x4_stream_routing"] = V(["prompts"], f"""
select conv_id, turn, {_PERS} personal, {_RES} resources, {_ROUTE} intent from prompts""")

_BRIEF_TAIL = ("Generate a short (4-5 sentences), direct, honest daily briefing.\n"
               "Include: progress status, what to focus on today, one free resource.\n"
               "Be a direct mentor, not a cheerleader. Use the numbers.\n")
SQL["t13_briefing_prompts"] = V(["users", "problems", "daily_log", "user_settings"], f"""
, pr as (select user_id, count(*) total, count(*) filter (where status = 'Solved') solved,
           count(*) filter (where status = 'Pending') pending, count(*) filter (where status = 'Skipped') skipped
         from problems group by user_id),
top3 as (select user_id, topic, rank from (
           select user_id, topic, row_number() over (partition by user_id order by count(*) desc, topic) rank
           from problems where status = 'Skipped' and topic <> '' group by user_id, topic) where rank <= 3),
weak as (select user_id, string_agg(topic, ', ' order by rank) weak from top3 group by user_id)
select u.id user_id,
  chr(10) || 'Student: ' || s.name || chr(10) || 'Days left to placement: ' ||
  cast(s.placement_deadline - {_lit(LOG)} as varchar) || chr(10) || 'Daily goal: ' ||
  cast(s.daily_goal as varchar) || ' problems' || chr(10) || 'Total problems in bank: ' ||
  cast(coalesce(pr.total, 0) as varchar) || chr(10) || 'Solved: ' || cast(coalesce(pr.solved, 0) as varchar) ||
  ' | Pending: ' || cast(coalesce(pr.pending, 0) as varchar) || ' | Skipped: ' ||
  cast(coalesce(pr.skipped, 0) as varchar) || chr(10) || 'Yesterday solved: ' ||
  cast(coalesce(l.problems_solved, 0) as varchar) || '/' || cast(s.daily_goal as varchar) || chr(10) ||
  'Weak topics (most skipped): ' || coalesce(weak.weak, 'None identified yet') || chr(10) || chr(10) ||
  {_q(_BRIEF_TAIL)} prompt
from users u left join pr on pr.user_id = u.id left join user_settings s on s.user_id = u.id
left join daily_log l on l.user_id = u.id and l.log_date = {_lit(LOG - dt.timedelta(days=1))}
left join weak on weak.user_id = u.id""")

SQL["t12_news_report"] = f"""
select run, '### Live Tech & Placement News' || chr(10) || chr(10) ||
  string_agg('- **[' || title || '](' || url || ')** — *' || source || '* `' || tag || '`', chr(10) order by rank)
  || chr(10) report
from ({_news_sql(6)}) d where rank <= 6 group by run"""

SQL["t9_status_text"] = V(["daily_plan", "problems"], f"""
, ctx as ({SQL["t9_status_context"]}),
pl as (select dp.user_id, dp.order_index, dp.problem_id,
         p.name || ' [' || p.category || ' - ' || p.difficulty || '] on ' || p.platform || ' — ' || dp.status line
       from daily_plan dp join problems p on p.id = dp.problem_id where dp.plan_date = {_lit(PLAN)}),
pn as (select user_id, string_agg('  ' || cast(rn as varchar) || '. ' || line, chr(10) order by rn) plan_str
       from (select *, row_number() over (partition by user_id order by order_index, problem_id, line) rn from pl)
       group by user_id)
select ctx.user_id, chr(10) || '[USER CURRENT STATUS — RAG DATA]' || chr(10) ||
  'Student: ' || name || chr(10) ||
  'Placement Deadline: ' || cast(placement_deadline as varchar) || ' (' || cast(days_left as varchar) ||
  ' days left)' || chr(10) ||
  'Daily Goal: ' || cast(daily_goal as varchar) || ' problems/day' || chr(10) ||
  'Today''s Progress: ' || cast(solved_today as varchar) || '/' || cast(daily_goal as varchar) || ' solved' || chr(10) ||
  'Streak: ' || cast(streak as varchar) || ' days' || chr(10) ||
  'Readiness Score: ' || cast(readiness as varchar) || '/100' || chr(10) || chr(10) ||
  'Problem Bank:' || chr(10) || '- Total: ' || cast(total as varchar) || ' | Solved: ' || cast(solved as varchar) ||
  ' (' || cast(solved_pct as varchar) || '%) | Pending: ' || cast(pending as varchar) || ' | Attempted: ' ||
  cast(attempted as varchar) || ' | Skipped: ' || cast(skipped as varchar) || chr(10) || chr(10) ||
  'Category Breakdown: ' || cat_breakdown || chr(10) ||
  'Target Pace: Need ' || (case when days_left > 0 then cast(needed_per_day as varchar)
                               else cast(remaining as varchar) end) ||
  ' problems/day to finish remaining ' || cast(remaining as varchar) || ' problems.' || chr(10) || chr(10) ||
  'Today''s Plan:' || chr(10) || coalesce(pn.plan_str, '  No tasks scheduled for today yet.') || chr(10) context
from ctx left join pn on pn.user_id = ctx.user_id""")

_SEP = "\n\n---\n**USER QUERY:**\n"
_RES_HEAD = "\n\n[ONLINE RESOURCES — include these links in your answer]:\n"
SQL["t13_prompts"] = V(["prompts"], f"""
, ctx as ({SQL["t9_status_text"]}),
m as (select p.conv_id, p.turn, p.message, c.context, {_PERS} and c.context is not null personal,
        {_RES} resources, {_ROUTE} intent, {_TOPIC} topic
      from prompts p left join ctx c on c.user_id = p.conv_id)
select conv_id, turn, personal, resources, intent,
  (case when personal then context || {_q(_SEP)} || message else message end) ||
  (case when resources then {_q(_RES_HEAD)} || '- ' || replace({_LINKS}, chr(10), chr(10) || '- ') else '' end)
    prompt
from m""")

SQL["s5_news_cache_json"] = f"""
select run, count(*)::bigint articles, arg_min(title, rank) first_title, arg_max(score, rank)::bigint last_score
from ({_news_sql(9)}) d group by run"""

SQL["s3_task_list_files"] = V(["tasks", "problems"], """
select user_id, 'add' mode, 'tasks_' || cast(seq // 1000 as varchar) || '.xlsx' filename,
  (row_number() over (partition by user_id, seq // 1000 order by seq) - 1)::bigint pos, name, topic, category,
  null::date scheduled_date
from tasks""")

SQL["s9_daily_cache"] = f"""
select *, date '2024-01-20' cache_date from ({_news_sql(9)}) d"""

SQL["x2_import_stream"] = V(["tasks", "problems"], f"""
{_T}
select null::bigint id, user_id, name, category, topic, difficulty, status, scheduled_date,
  'stream_0' import_batch, platform, problem_link, resource_link from ok""")

SQL["x1_status_stream"] = SQL["i9_status_log"]

SQL["s2_sheet_files"] = V(["sheet_cells"], _SHEETS + """
select name, category, topic, difficulty, platform, problem_link, resource_link, scheduled_date, status
from tasks_out where sheet in ('Topics', 'Week Plan')""")

SQL["s4_json_feed_files"] = V(["articles"], """
select 'feed' source, url, title, score, tag_hint from articles""")

# the same counts, kept by streams
SQL["x3_daily_stream"] = SQL["x3_daily_solved"]
SQL["x3_weekly_stream"] = SQL["x3_weekly_solved"]

SQL["i5_delete_category"] = V(["users", "problems", "daily_plan"], """
, gone as (select id from problems where lower(category) = 'economy'),
p as (select user_id, count(*) n from problems where id not in (select id from gone) group by user_id),
pl as (select user_id, count(*) n from daily_plan where problem_id not in (select id from gone) group by user_id)
select u.id user_id, coalesce(p.n, 0) problems_left, coalesce(pl.n, 0) plan_left
from users u left join p on p.user_id = u.id left join pl on pl.user_id = u.id""")

SQL["i7_problems_left"] = V(["problems"], """
select id, user_id, name, status from problems where not (status = 'Skipped' and difficulty = 'Hard')""")

SQL["i8_refresh_plans"] = V(["problems", "daily_plan"], f"""
, fresh as (select user_id, scheduled_date plan_date, id problem_id,
              (row_number() over (partition by user_id, scheduled_date order by {_RANK}, id) - 1) order_index, 'Pending' status
            from problems where status = 'Pending' and scheduled_date is not null),
days as (select distinct user_id, plan_date from fresh)
select dp.user_id, dp.plan_date, dp.problem_id, dp.order_index, dp.status
from daily_plan dp left join days d on d.user_id = dp.user_id and d.plan_date = dp.plan_date where d.user_id is null
union all select * from fresh""")

SQL["a2_named_categories"] = V(["problems"], """
select user_id, category, count(*)::bigint total, sum(case when status = 'Solved' then 1 else 0 end)::bigint solved
from problems where id % 5 <> 0 and category <> '' group by user_id, category""")

# --- files of two schemas, orphans, versions, orders, stored blocks, answers, the cache as one operator ---
from .reports import DEFAULT_ANSWER as _DEFAULT_ANSWER  # noqa: E402

SQL["l2_newest_projects"] = V(["projects"], """
select *, (row_number() over (partition by user_id order by id desc) - 1)::integer position from projects""")

SQL["l3_milestones_by_id"] = V(["milestones"], """
select *, (row_number() over (partition by project_id order by order_index, id) - 1)::integer position
from (select project_id, order_index % 3 order_index, deadline, status, project_id * 10 + order_index id
      from (select project_id, order_index, min(deadline) deadline, max(status) status from milestones group by all))""")

SQL["f8_migrate"] = V(["problems"], """
select id, user_id, name, case when id % 2 = 1 then status else 'Pending' end status,
  case when id % 2 = 1 and id % 3 <> 0 then import_batch else '' end import_batch, 1::bigint revision from problems""")

_OWNED = ("problems", "daily_plan", "daily_log", "projects", "settings", "feedback", "imports", "activity")
SQL["f9_claim_orphans"] = V(list(_OWNED), " union all ".join(
    f"select '{t}' tab, case when user_id % 3 <> 0 then user_id else 1 end user_id, count(*) \"rows\" from {t} group by all"
    for t in _OWNED))

SQL["w5_last_wins"] = V(["settings"], """
, ch as (select user_id, case event_type when 'error' then 'name' else 'daily_goal' end key,
           cast(event_id % 20 as varchar) value, event_id from events where event_type <> 'view'),
won as (select * exclude (rn) from (
          select *, row_number() over (partition by user_id, key order by event_id desc) rn from ch) where rn = 1)
select coalesce(w.user_id, s.user_id) user_id, coalesce(w.key, s.key) key, coalesce(w.value, s.value) value
from settings s full outer join won w on w.user_id = s.user_id and w.key = s.key""")

SQL["s6_stored_blocks"] = """
select conv_id, turn, case when json_valid(b) then json_extract_string(b, '$.youtube') end youtube,
  case when json_valid(b) then json_extract_string(b, '$.article') end article,
  case when json_valid(b) then json_extract_string(b, '$.practice') end practice
from (select conv_id, turn, nullif(regexp_extract(concat(text, case conv_id % 4
        when 0 then concat(' {"youtube": "y', turn, '", "article": "a", "practice": "p"} {"youtube": "z"}')
        when 1 then ' {"youtube": {"id": 1}, "article": "a"}' when 2 then ' {"youtube": "x", article}'
        else concat(chr(10), '{', chr(10), '"youtube": "y",', chr(10), '"practice": null}', chr(10)) end),
        '(?s)(\\{.*?\\})', 1), '') b
      from conversations where role = 'assistant')"""

SQL["t8_answers"] = V(["prompts"], f"""
, reports as (select user_id, 'daily' intent, report from ({SQL["t10_daily_text"]})
  union all select user_id, 'weekly', report from ({SQL["t12_weekly_text"]})
  union all select user_id, 'suggest', report from ({SQL["t11_text"]})),
m as (select conv_id, turn, {_ROUTE} intent from prompts)
select m.conv_id, m.turn, m.intent, coalesce(r.report, n.report, {_q(_DEFAULT_ANSWER)}) answer
from m left join reports r on r.user_id = m.conv_id and r.intent = m.intent
left join (select 'news' intent, report from ({SQL["t12_news_report"]}) where run = '0.0') n on n.intent = m.intent""")

SQL["s9_cache_reuse"] = f"""
with kept as (values ('reused', '2024-01-19', 2), ('next_day', '2024-01-20', 3), ('forced', '2024-01-19', 4), ('empty', '2024-01-19', 1))
select d.run, d.rank, d.url, cast(k.col1 as date) cache_date, k.col0 step
from ({_news_sql(9)}) d join kept k on d.rank <= k.col2"""
