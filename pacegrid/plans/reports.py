"""Per-user status documents, reports and assembled prompts.

Each report is one row per user built from the rollups (all users in one
job, D1, D4).  The structured columns are exposed next to the text so they
can be checked and reused.  Text is built with ``concat``/``format_string``
on the JVM; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..functions.numeric import py_round, ratio_pct
from ..operators import rollups as R
from ..operators import text as T
from ..operators.joins import day_value, plan_with_problems
from ..operators.sequences import numbered_lines, streak

NL = "\n"


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def problem_profile(users: DataFrame, problems: DataFrame) -> DataFrame:
    """A1 + A2 + A5 from one pass: status counts, category coverage and the
    ``category: solved/total`` breakdown text (categories in name order)."""
    per_cat = problems.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in R.STATUSES])
    piece = F.concat(_s("category"), F.lit(": "), _s("solved"), F.lit("/"), _s("total"))
    per_user = per_cat.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ["total", "solved", "attempted", "pending", "skipped"]],
        F.count(F.lit(1)).alias("cats_total"), F.count_if(F.col("solved") > 0).alias("cats_with_solved"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("category"), piece.alias("p")))),
                                 lambda x: x["p"]), ", ").alias("cat_breakdown"))
    cols = ["total", "solved", "attempted", "pending", "skipped", "cats_total", "cats_with_solved"]
    out = (users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
           .fillna(0, subset=cols).fillna("None", subset=["cat_breakdown"]))
    denom = F.when(F.col("cats_total") > 0, F.col("cats_total")).otherwise(F.lit(1))
    return (out.select("user_id", *[F.col(c).cast("bigint").alias(c) for c in cols], "cat_breakdown")
            .withColumn("solved_pct", ratio_pct("solved", "total"))
            .withColumn("coverage_pct", ratio_pct("cats_with_solved", denom)))


def plan_lines(plan: DataFrame, problems: DataFrame, day, with_platform: bool = True) -> DataFrame:
    """W6 + J1: each user's numbered plan lines for one day."""
    j = plan_with_problems(plan.filter(F.col("plan_date") == as_date(day)), problems)
    line = F.concat(_s("name"), F.lit(" ["), _s("category"), F.lit(" - "), _s("difficulty"), F.lit("]"),
                    (F.concat(F.lit(" on "), _s("platform")) if with_platform else F.lit("")),
                    F.lit(" — "), _s("plan_status"))
    return numbered_lines(j, ["user_id"], ["order_index", "problem_id"], line, name="plan_lines")


def status_context(users, problems, log, plan, user_settings, as_of, plan_day=None) -> DataFrame:
    """The status document of every user with its structured columns."""
    plan_day = plan_day or as_of
    prof = problem_profile(users, problems)
    st = streak(log, as_of)
    today = day_value(users, log, as_of, name="solved_today")
    lines = plan_lines(plan, problems, plan_day)
    j = (prof.join(user_settings, "user_id", "left").join(st, "user_id", "left").join(today, "user_id", "left")
         .join(lines, "user_id", "left").fillna(0, subset=["streak"]))
    score = F.col("solved_pct") * 0.60 + F.col("coverage_pct") * 0.20 + F.least(F.col("streak"), F.lit(20))
    # A7 from the same profile (no second pass over problems)
    days = F.greatest(F.lit(0).cast("bigint"), F.datediff("placement_deadline", as_date(as_of)).cast("bigint"))
    j = (j.withColumn("readiness", F.least(F.lit(100).cast("bigint"), py_round(score)))
         .withColumn("remaining", F.col("pending") + F.col("attempted"))
         .withColumn("days_left", days)
         .withColumn("needed_per_day", F.when(F.col("days_left") > 0,
                                              py_round(F.col("remaining").cast("double") / F.col("days_left"), 1))
                     .otherwise(F.col("remaining").cast("double")))
         .withColumn("needed_text", F.when(F.col("days_left") > 0, _s("needed_per_day"))
                     .otherwise(_s(F.col("remaining"))))
         .withColumn("plan_text", F.coalesce(
             F.concat(F.lit("  "), F.regexp_replace("plan_lines", NL, NL + "  ")),
             F.lit("  No tasks scheduled for today yet."))))
    text = F.concat(
        F.lit(NL + "[USER CURRENT STATUS — RAG DATA]" + NL),
        F.lit("Student: "), _s("name"), F.lit(NL),
        F.lit("Placement Deadline: "), _s("placement_deadline"), F.lit(" ("), _s("days_left"), F.lit(" days left)" + NL),
        F.lit("Daily Goal: "), _s("daily_goal"), F.lit(" problems/day" + NL),
        F.lit("Today's Progress: "), _s("solved_today"), F.lit("/"), _s("daily_goal"), F.lit(" solved" + NL),
        F.lit("Streak: "), _s("streak"), F.lit(" days" + NL),
        F.lit("Readiness Score: "), _s("readiness"), F.lit("/100" + NL + NL),
        F.lit("Problem Bank:" + NL + "- Total: "), _s("total"), F.lit(" | Solved: "), _s("solved"),
        F.lit(" ("), _s("solved_pct"), F.lit("%) | Pending: "), _s("pending"), F.lit(" | Attempted: "),
        _s("attempted"), F.lit(" | Skipped: "), _s("skipped"), F.lit(NL + NL),
        F.lit("Category Breakdown: "), _s("cat_breakdown"), F.lit(NL),
        F.lit("Target Pace: Need "), _s("needed_text"), F.lit(" problems/day to finish remaining "),
        _s("remaining"), F.lit(" problems." + NL + NL),
        F.lit("Today's Plan:" + NL), _s("plan_text"), F.lit(NL))
    return j.select("user_id", "name", "placement_deadline", "days_left", "daily_goal", "solved_today", "streak",
                    "readiness", "total", "solved", "solved_pct", "pending", "attempted", "skipped", "cat_breakdown",
                    "needed_per_day", "remaining", text.alias("context"))


def daily_report(users, problems, log, plan, user_settings, as_of) -> DataFrame:
    """Solved overall, pending, days left (not clamped, Q7), today's
    solved against the goal with its band, and today's tasks with icons."""
    prof = R.status_rollup(users, problems).select("user_id", "solved", "pending")
    today = day_value(users, log, as_of, name="solved_today")
    days = user_settings.select("user_id", F.datediff("placement_deadline", as_date(as_of)).cast("bigint")
                                .alias("days_left"))
    j = plan_with_problems(plan.filter(F.col("plan_date") == as_date(as_of)), problems)
    icon = (F.when(F.col("plan_status") == "Solved", "✅").when(F.col("plan_status") == "Skipped", "⏭️")
            .otherwise("🔲"))
    task = F.concat(icon, F.lit(" **"), _s("name"), F.lit("** ["), _s("category"), F.lit(" – "),
                    _s("difficulty"), F.lit("]"))
    tasks = (j.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "problem_id", task.alias("t")))),
                                 lambda x: x["t"]), NL).alias("task_lines"), F.count(F.lit(1)).alias("tasks")))
    out = (prof.join(user_settings.select("user_id", F.col("daily_goal").alias("goal")), "user_id", "left")
           .join(today, "user_id", "left").join(days, "user_id", "left").join(tasks, "user_id", "left")
           .fillna(0, subset=["tasks"]))
    band = (F.when(F.col("solved_today") == 0, "zero").when(F.col("solved_today") < F.col("goal"), "behind")
            .otherwise("done"))
    return out.select("user_id", "solved", "pending", "days_left", "solved_today", "goal", band.alias("band"),
                      F.col("tasks").cast("bigint").alias("tasks"),
                      F.coalesce("task_lines", F.lit("- No tasks scheduled. Import an Excel sheet to get started."))
                      .alias("task_lines"))


def suggestion_report(users, problems, user_settings, as_of) -> DataFrame:
    """Days left (not clamped), solved/total with a one-decimal percent,
    and the three most-skipped topics."""
    prof = R.status_rollup(users, problems).select("user_id", "total", "solved")
    days = user_settings.select("user_id", F.datediff("placement_deadline", as_date(as_of)).cast("bigint")
                                .alias("days_left"))
    top = R.top_skipped_topics(problems, 3)
    piece = F.concat(F.lit("**"), _s("topic"), F.lit("** ("), _s("skipped"), F.lit(" skipped)"))
    weak = top.groupBy("user_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), ", ").alias("weak_topics"))
    pct = F.when(F.col("total") != 0, py_round(F.col("solved") / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return (prof.join(days, "user_id", "left").join(weak, "user_id", "left")
            .select("user_id", "days_left", "solved", "total", pct.alias("solved_pct"), "weak_topics"))


def weekly_report(users, problems, log, user_settings, as_of) -> DataFrame:
    """The weekly summary (A10) with the overall solved/total."""
    wk = R.weekly_summary(users, log, user_settings, as_of)
    prof = R.status_rollup(users, problems).select("user_id", "total", "solved")
    return wk.join(prof, "user_id", "left")


# The wording of the reports.
RESOURCE_LINE = ("[NeetCode](https://neetcode.io) | [takeUforward](https://takeuforward.org) | "
                 "[IndiaBix](https://www.indiabix.com)")
NEXT_WEEK = (NL + "### Next Week Directives" + NL + "1. Tackle skipped problems first." + NL
             + "2. [NeetCode Roadmap](https://neetcode.io) for DSA structure." + NL
             + "3. [IndiaBix](https://www.indiabix.com) for Aptitude + Verbal." + NL)
RECOMMENDED = (NL + "### Recommended Resources" + NL
               + "- **DSA:** [NeetCode](https://neetcode.io) | [takeUforward](https://takeuforward.org)" + NL
               + "- **Aptitude & Verbal:** [IndiaBix](https://www.indiabix.com)" + NL
               + "- **SQL:** [SQLZoo](https://sqlzoo.net) | [LeetCode SQL 50](https://leetcode.com/studyplan/sql-50/)"
               + NL + "- **System Design:** [ByteByteGo](https://www.youtube.com/@ByteByteGo)" + NL)


DEFAULT_ANSWER = ("### Trainer Directive" + NL + "Keep working consistently. Focus on your weakest areas first." + NL
                  + "- **Priority**: DSA → Aptitude → Core CS (SQL/OOPs/CN)." + NL + "- **Practice daily on**: "
                  + RESOURCE_LINE + NL)


def _join(*parts) -> Column:
    """Texts and columns (``Column``) in one string."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def daily_text(report: DataFrame) -> DataFrame:
    """T10 text of ``daily_report``.  The goal is filled in on a day without a
    solved problem (Q6 fixed)."""
    c = F.col
    band = (F.when(c("band") == "zero", _join(" You have solved **0/", c("goal"), "** problems today. "
                                            "Every hour you delay costs you. Start now."))
            .when(c("band") == "behind", _join(" **", c("solved_today"), "/", c("goal"), "** done. You need **",
                                               c("goal") - c("solved_today"), "** more to hit your daily goal."))
            .otherwise(_join(" Daily goal of ", c("goal"), " achieved! Strong consistency builds placements.")))
    return report.select("user_id", _join(
        "### Your Numbers for Today" + NL + "- **Solved overall:** ", c("solved"), " | **Pending:** ", c("pending"),
        " | **Days left:** ", c("days_left"), NL + "- **Today:** ", c("solved_today"), "/", c("goal"),
        " done" + NL + NL + "### Reality Check" + NL, band, NL + NL + "### Today's Tasks" + NL, c("task_lines"),
        NL + NL + "### Resources" + NL + RESOURCE_LINE + NL).alias("report"))


def suggestion_text(report: DataFrame) -> DataFrame:
    """T11 text of ``suggestion_report``."""
    c = F.col
    pct = F.when(c("total") != 0, c("solved_pct").cast("string")).otherwise("0")
    weak = (F.when(c("weak_topics").isNotNull(), _join("🚨 Topics you keep skipping: ", c("weak_topics"),
                                                       NL + "Spend 2 focused days on these." + NL))
            .otherwise("✅ No heavy skipping pattern. Keep tackling harder problems." + NL))
    return report.select("user_id", _join(
        "### Priority Study Directives" + NL + "- **Time left:** ", c("days_left"), " days | **Solved:** ",
        c("solved"), "/", c("total"), " (", pct, "%)" + NL + NL + "### Weak Areas" + NL, weak,
        RECOMMENDED).alias("report"))


def weekly_text(report: DataFrame) -> DataFrame:
    """T12 text of ``weekly_report``."""
    c = F.col
    days = (F.when(c("low_days"), _join(" Only ", c("days_studied"), "/7 days studied. Aim for 6 minimum." + NL))
            .otherwise(_join(" Good consistency — ", c("days_studied"), "/7 days studied." + NL)))
    of = _join(c("week_solved"), "/", c("week_goal"))
    band = (F.when(c("band") == "behind", _join(" Behind target: ", of, ". Increase volume." + NL))
            .when(c("band") == "smashed", _join(" Target smashed! ", of, "." + NL))
            .otherwise(_join(" Decent: ", of, ". Push harder next week." + NL)))
    return report.select("user_id", _join(
        "### Weekly Performance" + NL + "- **Solved this week:** ", of, " | **Days studied:** ", c("days_studied"),
        "/7 | **Overall:** ", c("solved"), "/", c("total"), NL + NL + "### Reality Check" + NL, days, band,
        NEXT_WEEK).alias("report"))


def news_report(digest: DataFrame, n: int = 6) -> DataFrame:
    """T12 news: per run, the top n digest entries as one markdown list."""
    line = F.concat(F.lit("- **["), _s("title"), F.lit("]("), _s("url"), F.lit(")** — *"), _s("source"),
                    F.lit("* `"), _s("tag"), F.lit("`"))
    top = digest.filter(F.col("rank") <= n)
    return top.groupBy("run").agg(F.concat(F.lit("### Live Tech & Placement News" + NL + NL), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), NL),
        F.lit(NL)).alias("report"))


def rule_answers(messages: DataFrame, daily: DataFrame, weekly: DataFrame, suggestion: DataFrame,
                 news: DataFrame) -> DataFrame:
    """The answer of each message (conv_id, turn, message) by its route: the user's daily, weekly or suggestion
    report (user_id, report), the ``report`` of the one row of ``news``, else the default text.  The user of a
    conversation is its ``conv_id``; a user without a report gets the default text too.
    """
    reports = None
    for intent, r in (("daily", daily), ("weekly", weekly), ("suggest", suggestion)):
        rows = r.select("user_id", F.lit(intent).alias("intent"), "report")
        reports = rows if reports is None else reports.unionByName(rows)
    m = messages.select("conv_id", "turn", F.col("conv_id").alias("user_id"), T.route("message").alias("intent"))
    latest_news = news.select(F.lit("news").alias("intent"), F.col("report").alias("news"))
    return (m.join(reports, ["user_id", "intent"], "left").join(latest_news, "intent", "left")
            .select("conv_id", "turn", "intent", F.coalesce("report", "news", F.lit(DEFAULT_ANSWER)).alias("answer")))


SEPARATOR = NL + NL + "---" + NL + "**USER QUERY:**" + NL
RESOURCE_HEADER = NL + NL + "[ONLINE RESOURCES — include these links in your answer]:" + NL


def assemble_prompts(prompts: DataFrame, contexts: DataFrame, route_on: str = "message") -> DataFrame:
    """For each message, the status context in front when it asks about
    the user's own status, and a link block behind when it asks for
    resources.  The user of a conversation is its ``conv_id``.

    ``route_on='prompt'`` routes on the assembled prompt, as the tracker's
    fallback did (Q19: a personal question then carries "Today's" and goes to
    the daily report); the default routes on the message itself."""
    p = prompts.withColumn("user_id", F.col("conv_id"))
    j = p.join(contexts.select("user_id", "context"), "user_id", "left")
    personal = T.needs_personal_context("message") & F.col("context").isNotNull()
    body = F.when(personal, F.concat("context", F.lit(SEPARATOR), "message")).otherwise(F.col("message"))
    links = F.concat(F.lit("- "), F.regexp_replace(T.resource_links(T.resource_topic("message")), NL, NL + "- "))
    prompt = F.when(T.wants_resources("message"), F.concat(body, F.lit(RESOURCE_HEADER), links)).otherwise(body)
    routed = T.route(prompt) if route_on == "prompt" else T.route("message")
    return j.select("conv_id", "turn", personal.alias("personal"), T.wants_resources("message").alias("resources"),
                    routed.alias("intent"), prompt.alias("prompt"))


BRIEFING_TAIL = ("Generate a short (4-5 sentences), direct, honest daily briefing." + NL
                 + "Include: progress status, what to focus on today, one free resource." + NL
                 + "Be a direct mentor, not a cheerleader. Use the numbers." + NL)


def briefing_prompts(users, problems, log, user_settings, as_of) -> DataFrame:
    """T13 briefing: per user, the prompt built from the status counts (A1),
    yesterday's solved count (J6) and the three most-skipped topics (A3);
    days left are not clamped (Q7)."""
    import datetime as _dt
    d = _dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    prof = R.status_rollup(users, problems)
    yday = day_value(users, log, d - _dt.timedelta(days=1), name="yesterday_solved")
    weak = (R.top_skipped_topics(problems, 3).groupBy("user_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))),
                                          lambda x: x["topic"]), ", ").alias("weak")))
    j = (prof.join(user_settings, "user_id", "left").join(yday, "user_id", "left").join(weak, "user_id", "left")
         .withColumn("days_left", F.datediff("placement_deadline", as_date(d)).cast("bigint")))
    text = F.concat(
        F.lit(NL + "Student: "), _s("name"), F.lit(NL + "Days left to placement: "), _s("days_left"),
        F.lit(NL + "Daily goal: "), _s("daily_goal"), F.lit(" problems" + NL + "Total problems in bank: "),
        _s("total"), F.lit(NL + "Solved: "), _s("solved"), F.lit(" | Pending: "), _s("pending"),
        F.lit(" | Skipped: "), _s("skipped"), F.lit(NL + "Yesterday solved: "), _s("yesterday_solved"), F.lit("/"),
        _s("daily_goal"), F.lit(NL + "Weak topics (most skipped): "),
        F.coalesce(F.col("weak"), F.lit("None identified yet")), F.lit(NL + NL + BRIEFING_TAIL))
    return j.select("user_id", text.alias("prompt"))
