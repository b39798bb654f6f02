"""The tracker's writes as functions (current tables, change set) -> new tables (D3).

No row is updated in place.  Each function returns the table as it is after
the change; a writer stores it with a dynamic partition overwrite (see
``pacegrid.sources.sinks``).  Change sets are DataFrames, so one call applies
the changes of every user at once.

Scale notes.  Keys are matched with equi-joins (sort-merge at scale) and
anti joins; "latest change per key" is a ``max_by`` aggregate with a
map-side partial step, so a hot key is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date
from .filters import TASK_DEFAULTS, fill_defaults
from .sequences import SLICE_ROWS, difficulty_rank, skew_safe_positions

TASK_FIELDS = ["name", "category", "topic", "difficulty", "platform", "problem_link", "resource_link",
               "scheduled_date"]


def _prepare_tasks(tasks: DataFrame) -> DataFrame:
    """Trim names, drop blank ones, fill defaults, force status Pending."""
    t = tasks
    if "scheduled_date" not in t.columns:
        t = t.withColumn("scheduled_date", F.lit(None).cast("date"))
    t = fill_defaults(t.withColumn("name", F.trim(F.coalesce("name", F.lit("")))), TASK_DEFAULTS)
    return t.withColumn("status", F.lit("Pending"))


def import_add(problems: DataFrame, tasks: DataFrame, batch_id: str) -> DataFrame:
    """The rows an ``add`` import inserts.

    A task is skipped when its (user, trimmed name, topic) is already stored
    or occurs earlier (smaller ``seq``) in the same batch; ``seq`` (a number or a struct) orders the
    tasks of one user and need not be unique: of tasks that share key and ``seq`` one is imported, the
    least of their other columns.  One aggregate keeps a row per key on every mapper, so a task repeated any
    number of times meets no task as such.
    """
    first = _first_tasks(_prepare_tasks(tasks).filter(F.col("name") != ""), problems)
    return (first.select(*TASK_KEY, "_first.*").select(*_prepare_tasks(tasks).columns)
            .withColumn("import_batch", F.lit(batch_id)))


TASK_KEY = ["user_id", "name", "topic"]


def task_keys(tasks: DataFrame) -> DataFrame:
    """The keys (user, trimmed name, topic) under which tasks are looked up."""
    return _prepare_tasks(tasks).filter(F.col("name") != "").select(*TASK_KEY).distinct()


def _rest(tasks: DataFrame) -> Column:
    return F.struct("seq", *[c for c in tasks.columns if c not in (*TASK_KEY, "seq", "_copies")])


def _first_tasks(tasks: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, name, topic, _first): the first task of each key that is not stored."""
    return (tasks.filter(F.col("user_id").isNotNull()).groupBy(*TASK_KEY).agg(F.min(_rest(tasks)).alias("_first"))
            .join(problems.select(*TASK_KEY), TASK_KEY, "left_anti"))


def import_flags(problems: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every task with its outcome: ``blank``, ``duplicate`` or ``imported``.  Equal rows are counted first, so of them
    at most one is imported."""
    t = _prepare_tasks(tasks)
    rows = t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("_copies"))
    first = _first_tasks(rows.filter(F.col("name") != ""), problems)
    wins = F.col("_first").isNotNull() & _rest(rows).eqNullSafe(F.col("_first"))
    outcome = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_copies")), lambda k: F.when(F.col("name") == "", "blank")
                          .when(wins & (k == 1), "imported").otherwise("duplicate"))
    return rows.join(first, TASK_KEY, "left").select(*t.columns, F.explode(outcome).alias("outcome"))


def import_totals(flags: DataFrame) -> DataFrame:
    """Per user, imported and skipped-duplicate counts of one batch."""
    return flags.groupBy("user_id").agg(
        F.count_if(F.col("outcome") == "imported").alias("imported"),
        F.count_if(F.col("outcome") == "duplicate").alias("skipped"))


def import_replace(problems: DataFrame, imports: DataFrame, tasks: DataFrame, batch_id: str) -> DataFrame:
    """``replace`` import.  For every importing user, the unprotected
    problems are removed first (hand-added rows too, Q17), then all non-blank
    tasks are inserted without a duplicate check.  Other users keep all rows.
    Returns the new problems table with an ``origin`` column."""
    t = _prepare_tasks(tasks).filter(F.col("name") != "")
    importers = t.select("user_id").distinct()
    kept = _keep_protected_of(problems, imports, importers)
    cols = ["user_id", *TASK_FIELDS, "status", "import_batch"]
    ins = t.withColumn("import_batch", F.lit(batch_id))
    return (kept.select(*cols).withColumn("origin", F.lit("kept"))
            .unionByName(ins.select(*cols).withColumn("origin", F.lit("inserted"))))


def _keep_protected_of(problems: DataFrame, imports: DataFrame, users: DataFrame) -> DataFrame:
    """Problems after removing, for the given users, every row outside their
    protected import batches (other users keep everything).  Two flag joins
    and a filter: no anti join of ``problems`` with itself."""
    return _flag_removed(problems, imports, users).filter(~F.col("_gone")).select(*problems.columns)


def replaced_plan(problems: DataFrame, plan: DataFrame, imports: DataFrame, tasks: DataFrame) -> DataFrame:
    """I2 cascade: the plan without the rows of the problems that a ``replace``
    import of ``tasks`` removes."""
    importers = _prepare_tasks(tasks).filter(F.col("name") != "").select("user_id").distinct()
    gone = _flag_removed(problems, imports, importers).filter("_gone").select(
        "user_id", F.col("id").alias("problem_id"))
    return plan.join(gone, ["user_id", "problem_id"], "left_anti")


def _flag_removed(problems: DataFrame, imports: DataFrame, users: DataFrame) -> DataFrame:
    """``problems`` with ``_gone``: owned by one of ``users`` and in no protected batch of theirs."""
    prot = (imports.filter(F.col("protected"))
            .select("user_id", F.col("batch_id").alias("import_batch")).distinct()
            .withColumn("_prot", F.lit(True)))
    flagged = (problems.join(users.select("user_id").distinct().withColumn("_hit", F.lit(True)), "user_id", "left")
               .join(prot, ["user_id", "import_batch"], "left"))
    return flagged.withColumn("_gone", F.col("_hit").isNotNull() & F.col("_prot").isNull())


def ledger_rows(totals: DataFrame, files: DataFrame, batch_id: str, as_of) -> DataFrame:
    """One ledger row per (user, file) of the batch, each carrying the
    user's whole-batch total; the batch id is stored (Q2 fixed)."""
    return (files.join(totals.select("user_id", "imported"), "user_id", "inner")
            .select("user_id", "filename", as_date(as_of).alias("import_date"),
                    F.col("imported").alias("total_imported"), F.lit(batch_id).alias("batch_id"),
                    F.lit(False).alias("protected")))


def toggle_protection(imports: DataFrame, toggles: DataFrame) -> DataFrame:
    """I4: flip ``protected`` of the ledger rows whose (id, user_id) is toggled."""
    t = toggles.select("id", "user_id").distinct().withColumn("_flip", F.lit(True))
    return (imports.join(t, ["id", "user_id"], "left")
            .withColumn("protected", F.when(F.col("_flip"), ~F.col("protected")).otherwise(F.col("protected")))
            .drop("_flip"))


def delete_problems(problems: DataFrame, plan: DataFrame, imports: DataFrame, batch: str | None = None,
                    category: str | None = None, date_from=None, date_to=None):
    """Delete one batch, one category or a date range, with the plan rows
    of the deleted problems.  A batch that is protected for a user is refused
    for that user.  Returns ``(problems, plan, refused)``."""
    refused = None
    if batch:
        prot = imports.filter(F.col("protected") & (F.col("batch_id") == batch)).select("user_id").distinct()
        refused = prot.withColumn("batch", F.lit(batch))
        flagged = problems.join(prot.withColumn("_refused", F.lit(True)), "user_id", "left")
        cond = (F.col("import_batch") == batch) & F.col("_refused").isNull()
    elif category:
        flagged, cond = problems, F.lower("category") == F.lower(F.lit(category))
    else:
        flagged, cond = problems, F.col("scheduled_date").between(as_date(date_from), as_date(date_to))
    cond = F.coalesce(cond, F.lit(False))
    # survivors are a filter (no self-join); the plan cascade needs the ids
    new_problems = flagged.filter(~cond).select(*problems.columns)
    gone = flagged.filter(cond).select(F.col("id").alias("problem_id"))
    new_plan = plan.join(gone, "problem_id", "left_anti")
    return new_problems, new_plan, refused


def clear_imports(problems: DataFrame, plan: DataFrame, log: DataFrame, imports: DataFrame,
                  clearing_users: DataFrame):
    """For the clearing users drop all plan and log rows, the problems
    outside their protected batches and their unprotected ledger rows.
    Returns ``(problems, plan, log, imports)``."""
    u = clearing_users.select("user_id").distinct()
    return (_keep_protected_of(problems, imports, u),
            plan.join(u, "user_id", "left_anti"),
            log.join(u, "user_id", "left_anti"),
            imports.join(u, "user_id", "left_anti").unionByName(
                imports.join(u, "user_id", "left_semi").filter(F.col("protected"))))


def delete_one(problems: DataFrame, plan: DataFrame, ids: DataFrame):
    """Delete the given (id, user_id) problems and their plan rows."""
    k = ids.select("id", "user_id").distinct()
    return (problems.join(k, ["id", "user_id"], "left_anti"),
            plan.join(k.withColumnRenamed("id", "problem_id"), ["problem_id", "user_id"], "left_anti"))


def generate_plans(problems: DataFrame, dates: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """I8: plan rows of every (user, day): the Pending problems scheduled that
    day, Easy first then Medium then the rest, by id; index from 0.

    ``dates`` optionally restricts to wanted (user_id, plan_date) pairs.
    Positions come from ``skew_safe_positions`` so one huge (user, day) group
    is still numbered by many tasks.
    """
    p = (problems.filter((F.col("status") == "Pending") & F.col("scheduled_date").isNotNull())
         .select("user_id", F.col("scheduled_date").alias("plan_date"), F.col("id").alias("problem_id"),
                 difficulty_rank().alias("_rank")))
    if dates is not None:
        p = p.join(dates.select("user_id", "plan_date").distinct(), ["user_id", "plan_date"], "left_semi")
    pos = skew_safe_positions(p, ["user_id", "plan_date"], ["_rank"], "problem_id", name="order_index",
                              slice_rows=slice_rows)
    return pos.select("user_id", "plan_date", "problem_id", "order_index", F.lit("Pending").alias("status"))


def refresh_plans(plan: DataFrame, generated: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """I8 refresh: the generated (user, day) plans replace the stored ones.

    ``dates`` names the refreshed (user_id, plan_date) pairs; the stored plan of a wanted day goes even if
    the day generates no row.  Without it the generated days are the wanted ones.
    """
    keys = (generated if dates is None else dates).select("user_id", "plan_date").distinct()
    return plan.join(keys, ["user_id", "plan_date"], "left_anti").unionByName(generated)


def latest(events: DataFrame, key: list[str], ts: str = "ts") -> DataFrame:
    """W5 on a change stream: the last event per key (ties: larger row)."""
    rest = [c for c in events.columns if c not in key]
    return (events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.struct(*rest))).alias("_r"))
            .select(*key, "_r.*"))


def apply_status_events(problems: DataFrame, plan: DataFrame, log: DataFrame, user_settings: DataFrame,
                        events: DataFrame):
    """Status events ``(user_id, problem_id, plan_date, status, ts)``.

    * problems: the latest event of the owner per problem sets its status;
    * plan: the latest event per (problem, day) sets the matching plan rows;
    * log: each touched (user, day) gets ``problems_solved`` = solved plan
      rows of that day and ``problems_target`` = goal; other fields of an
      existing row are kept (Q4 fixed), a new row gets zeros.

    An event without a day sets the problem alone; events on another user's problem are ignored.
    Returns ``(problems, plan, log)``.
    """
    last = latest(events.select(*OWN, "status", "ts"), OWN)
    per_day = owned_changes(problems, events).filter(F.col("plan_date").isNotNull())
    return (problems_after(problems, last), plan_after(plan, per_day), _recounted_log(plan, log, user_settings, per_day))


OWN = ["user_id", "problem_id"]
DAY = [*OWN, "plan_date"]


def owned_changes(problems: DataFrame, events: DataFrame) -> DataFrame:
    """The latest event per (user, problem, day) on the user's own problems: (user_id, problem_id, plan_date, status, ts)."""
    own = problems.select("user_id", F.col("id").alias("problem_id"))
    owned = events.select(*DAY, "status", "ts").join(own, OWN, "left_semi")
    return (owned.groupBy(*DAY).agg(F.max(F.struct("ts", "status")).alias("_e"))
            .select(*DAY, F.col("_e")["status"].alias("status"), F.col("_e")["ts"].alias("ts")))


def problems_after(problems: DataFrame, changes: DataFrame) -> DataFrame:
    """``problems`` with the status of ``changes`` (one row per user and problem)."""
    last = changes.select("user_id", F.col("problem_id").alias("id"), F.col("status").alias("_new"))
    return _with_status(problems, last, ["user_id", "id"])


def plan_after(plan: DataFrame, changes: DataFrame, part: str = "plan_date") -> DataFrame:
    """``plan`` with the status of ``changes`` (one row per user, problem and day).  ``part``: a column of both that
    the day determines; rows are matched in its order first, so a writer that is partitioned by it need not sort again."""
    key = [part, *[c for c in DAY if c != part]]
    return _with_status(plan, changes.select(*key, F.col("status").alias("_new")), key)


def _with_status(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the status ``_new`` of the matching change."""
    return table.join(changes, key, "left").select(
        *[F.coalesce("_new", "status").alias("status") if c == "status" else F.col(c) for c in table.columns])


def _recounted_log(plan: DataFrame, log: DataFrame, user_settings: DataFrame, per_day: DataFrame) -> DataFrame:
    """The log after the owned events, by two reductions over tagged rows instead of a chain of joins.

    Plan rows and the last events (``per_day``) meet per (user, problem, day): their number, the solved ones and the event
    say how many of them are solved now; all are numbers, so this reduction hashes and sorts nothing.  These counts and the
    log rows meet per (user, day).  Both reductions start on the mappers.
    """
    status = F.col("status")
    event = F.when(status.isNull(), 0).when(status == "Solved", 2).otherwise(1)
    marks = (plan.filter(F.col("plan_date").isNotNull())
             .select(*DAY, F.lit(1).alias("rows"), (status == "Solved").cast("int").alias("was"), F.lit(None).cast("int").alias("event"))
             .unionByName(per_day.select(*DAY, F.lit(0).alias("rows"), F.lit(0).alias("was"), event.alias("event"))))
    now = marks.groupBy(*DAY).agg(F.sum("rows").alias("rows"), F.sum("was").alias("was"), F.max("event").alias("event"))
    counts = now.select(
        "user_id", F.col("plan_date").alias("log_date"), F.col("event").isNotNull().alias("touched"),
        F.when(F.col("event") == 2, F.col("rows")).when(F.col("event") == 1, F.lit(0)).otherwise(F.col("was")).alias("solved"))
    stored = F.struct(*_log_fields(log))
    tagged = (counts.withColumn("row", F.lit(None).cast(log.select(stored.alias("r")).schema["r"].dataType))
              .unionByName(log.select("user_id", "log_date", F.lit(False).alias("touched"),
                                      F.lit(0).cast("bigint").alias("solved"), stored.alias("row"))))
    days = (tagged.groupBy("user_id", "log_date")
            .agg(F.max("touched").alias("touched"), F.coalesce(F.sum("solved"), F.lit(0)).alias("solved"), F.max("row").alias("row"))
            .filter(F.col("touched") | F.col("row").isNotNull()))
    return _log_rows(days, log, user_settings)


def log_after(plan: DataFrame, log: DataFrame, user_settings: DataFrame, per_day: DataFrame) -> DataFrame:
    """The log after the events ``per_day`` from the ``plan`` as they leave it, so that plan rows and events need not meet
    per problem again.  Log rows are first reduced to one per day; then all that meets per (user, day) are numbers and flags
    (with the notes, where the log has them)."""
    key = ["user_id", "log_date"]
    fields = _log_fields(log)
    day = F.col("plan_date").alias("log_date")
    no, none = F.lit(False), F.lit(0).cast("bigint")
    empty = [F.lit(None).cast(log.schema[c].dataType).alias(f"_{c}") for c in fields]
    dated = F.col("plan_date").isNotNull()
    own = log.groupBy(*key).agg(F.max(F.struct(*fields)).alias("_r"))
    tagged = (plan.filter(dated).select("user_id", day, no.alias("touched"), (F.col("status") == "Solved").cast("bigint").alias("solved"),
                                        no.alias("in_log"), *empty)
              .unionByName(per_day.filter(dated).select("user_id", day, F.lit(True).alias("touched"), none.alias("solved"),
                                                        no.alias("in_log"), *empty))
              .unionByName(own.select(*key, no.alias("touched"), none.alias("solved"), F.lit(True).alias("in_log"),
                                      *[F.col("_r")[c].alias(f"_{c}") for c in fields])))
    days = (tagged.groupBy(*key)
            .agg(F.max("touched").alias("touched"), F.coalesce(F.sum("solved"), F.lit(0)).alias("solved"), F.max("in_log").alias("in_log"),
                 *[F.max(f"_{c}").alias(f"_{c}") for c in fields])
            .filter(F.col("touched") | F.col("in_log")))
    row = F.struct(*[F.col(f"_{c}").alias(c) for c in fields])
    return _log_rows(days.select(*key, "touched", "solved", row.alias("row")), log, user_settings)


def _log_fields(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("user_id", "log_date")]


def _log_rows(days: DataFrame, log: DataFrame, user_settings: DataFrame) -> DataFrame:
    """Log rows of ``days``: touched ones get their count and the user's goal, the rest is as in the stored ``row``."""
    goals = user_settings.select("user_id", F.col("daily_goal").alias("goal"))
    r = F.col("row")
    return days.join(goals, "user_id", "left").select(
        "user_id", "log_date",
        F.when(F.col("touched"), F.col("solved")).otherwise(r["problems_solved"]).cast("bigint").alias("problems_solved"),
        F.coalesce(r["problems_attempted"], F.lit(0)).cast("bigint").alias("problems_attempted"),
        F.coalesce(r["problems_skipped"], F.lit(0)).cast("bigint").alias("problems_skipped"),
        F.when(F.col("touched"), F.coalesce("goal", F.lit(10))).otherwise(r["problems_target"]).cast("bigint")
        .alias("problems_target"),
        *[F.coalesce(r[c], F.lit(d)).cast(log.schema[c].dataType).alias(c)
          for c, d in ACTIVITY_NOTES.items() if c in log.columns])


# Optional columns of the log with the value of an entry that does not give them.
ACTIVITY_NOTES = {"study_hours": 0.0, "mood": "", "notes": ""}


def upsert_activity(log: DataFrame, activity: DataFrame, user_settings: DataFrame) -> DataFrame:
    """An activity entry replaces the whole (user, day) row: its solved
    count, zero attempted/skipped unless given, target = the user's goal.
    ``study_hours``, ``mood`` and ``notes`` are kept where the log or the
    entries have them (0 and empty texts where not given)."""
    notes = [c for c in ACTIVITY_NOTES if c in log.columns or c in activity.columns]
    a = activity.join(user_settings.select("user_id", F.col("daily_goal").alias("problems_target")),
                      "user_id", "left")
    a = latest(a.select("user_id", "log_date", "problems_solved",
                        *[F.coalesce(F.col(c) if c in activity.columns else F.lit(None), F.lit(0))
                          .cast("bigint").alias(c) for c in ("problems_attempted", "problems_skipped")],
                        F.coalesce("problems_target", F.lit(10)).cast("bigint").alias("problems_target"), "ts",
                        *_notes(a, notes)),
               ["user_id", "log_date"]).drop("ts")
    cols = ["user_id", "log_date", "problems_solved", "problems_attempted", "problems_skipped", "problems_target"]
    log, cols = log.select(*cols, *_notes(log, notes)), [*cols, *notes]
    return (log.join(a.select("user_id", "log_date"), ["user_id", "log_date"], "left_anti")
            .unionByName(a.select(*cols)))


def _notes(df: DataFrame, names: list[str]) -> list:
    """The optional log columns, with their defaults where absent or NULL."""
    return [F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(ACTIVITY_NOTES[c])).alias(c)
            for c in names]


PROJECT_DEFAULTS = {"name": "", "description": "", "tech_stack": "", "target_date": None, "status": "In Progress",
                    "github_link": "", "completion_pct": 0}
MILESTONE_DEFAULTS = {"name": "", "description": "", "deadline": None, "status": "Pending", "order_index": 0}


def _given(changes: DataFrame, table: DataFrame, name: str, defaults: dict):
    """Column ``name`` of a change in the type of ``table``, its default where not given."""
    c = F.col(name) if name in changes.columns else F.lit(None)
    c = c if defaults.get(name) is None else F.coalesce(c, F.lit(defaults[name]))
    return c.cast(table.schema[name].dataType).alias(name)


def _latest_change(changes: DataFrame, key: list[str]) -> DataFrame:
    """The last change per key by ``ts``; without ``ts`` one row per key, the largest."""
    if "ts" in changes.columns:
        return latest(changes, key).drop("ts")
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*")


def add_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """I11 insert: ``new`` has (id, user_id) and any of the project fields."""
    return projects.unionByName(new.select(*[_given(new, projects, c, PROJECT_DEFAULTS) for c in projects.columns]))


def update_projects(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """I11 update: the latest change of an (id, user_id) replaces all fields of
    that project, a field it does not give by its default; another user's
    project is left alone."""
    key = ["id", "user_id"]
    fields = [c for c in projects.columns if c in PROJECT_DEFAULTS]
    ch = _latest_change(changes, key)
    ch = ch.select(*key, F.struct(*[_given(ch, projects, c, PROJECT_DEFAULTS) for c in fields]).alias("_new"))
    j = projects.join(ch, key, "left")
    return j.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
                      if c in fields else F.col(c) for c in projects.columns])


def _owned_projects(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias("project_id"), "user_id")


def add_milestones(milestones: DataFrame, projects: DataFrame, new: DataFrame) -> DataFrame:
    """I11 insert of milestones (project_id, user_id, fields) into the user's own projects."""
    own = new.join(_owned_projects(projects), ["project_id", "user_id"], "left_semi")
    return milestones.unionByName(
        own.select(*[_given(own, milestones, c, MILESTONE_DEFAULTS) for c in milestones.columns]))


def delete_milestones(milestones: DataFrame, projects: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """I11 delete of the milestones that ``keys`` (``key``, project_id, user_id) names in the user's own projects."""
    own = keys.join(_owned_projects(projects), ["project_id", "user_id"], "left_semi")
    return milestones.join(own.select(*key), key, "left_anti")


def update_milestones(milestones: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The latest change per key sets the status, name and deadline it
    gives (completion is always derived by ``project_completion``, so
    add/update/delete all refresh it)."""
    fields = [c for c in ("status", "name", "deadline") if c in changes.columns and c in milestones.columns]
    ch = _latest_change(changes, key).select(*key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    j = milestones.join(ch, key, "left")
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in milestones.columns])


def delete_projects(projects: DataFrame, milestones: DataFrame, ids: DataFrame):
    """I11 delete with cascade to milestones (Q18 fixed)."""
    k = ids.select(F.col("id")).distinct()
    return (projects.join(k, "id", "left_anti"),
            milestones.join(k.withColumnRenamed("id", "project_id"), "project_id", "left_anti"))


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per (user, key); a change replaces the stored value."""
    ch = changes.withColumn("value", F.col("value").cast("string"))
    ch = (latest(ch.select("user_id", "key", "value", "ts"), ["user_id", "key"]).drop("ts")
          if "ts" in ch.columns else ch.groupBy("user_id", "key").agg(F.max("value").alias("value")))
    return (settings.join(ch.select("user_id", "key"), ["user_id", "key"], "left_anti")
            .unionByName(ch.select("user_id", "key", "value")))


def upsert_mastery(mastery: DataFrame, changes: DataFrame) -> DataFrame:
    """Per-user mastery keyed by (user_id, algorithm_id) (Q9 fixed);
    the latest change per key wins."""
    last = latest(changes, ["user_id", "algorithm_id"]).drop("ts")
    cols = ["user_id", "algorithm_id", "mastery", "solved_problems"]
    return (mastery.select(*cols).join(last.select("user_id", "algorithm_id"), ["user_id", "algorithm_id"],
                                       "left_anti")
            .unionByName(last.select(*cols)))
