r"""Chat formatting by event-sourced reconstruction (native DataFrame operations only).

An event log has (conv_id, seq, msg, role, kind, text).  Within a conversation, in order of seq:

* ``message`` / ``delta``: text is appended to message ``msg``;
* ``edit``: the text of message ``msg`` is replaced;
* ``regenerate``: message ``msg`` and all later messages are discarded, and ``msg`` starts anew.

An event therefore counts unless a later regenerate names its message or an earlier one, or a later
edit names its message.  Both tests are running window aggregates in the order of the log, so no
conversation is gathered before its messages are folded.  A message's role is that of its last
event that counts and has one.

Rendered turn: ``<s>[INST]role[/INST]text</s>``.  Inside role and text a backslash is doubled and a
backslash is put behind the first character of ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``, so
control strings of the template occur only as control strings and ``unescape`` gives the text back.
The loss mask lists (start, length) in code points of each assistant text in the rendered string.

Null text and null role are empty; null ids form a conversation of their own; rows that share a
sequence number are taken in the order of message, role and text; repeated rows count as often as they
occur; an empty log gives an empty result.  One rendered string per conversation is the result, so
a conversation's text meets in the task that renders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(c, r"<(?=/?s>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def message_events(conversations: DataFrame) -> DataFrame:
    """Finished rows (conv_id, turn, role, text) as a log: each row, by turn, is one message."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (rows.withColumn("seq", F.row_number().over(order).cast("long"))
            .select("conv_id", "seq", F.col("seq").alias("msg"), "role",
                    F.lit("message").alias("kind"), "text"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, msg, role, text)."""
    e = events.select("conv_id", "seq", "msg", "role", F.lower("kind").alias("kind"),
                      F.coalesce("text", F.lit("")).alias("text"))
    later = (Window.partitionBy("conv_id").orderBy(F.desc("seq"))
             .rangeBetween(Window.unboundedPreceding, -1))
    anew = F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)
    edited = F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(Window.partitionBy("conv_id", "msg"))
    alive = (e.withColumn("_anew", anew).withColumn("_edited", edited)
             .filter((F.col("_anew").isNull() | (F.col("_anew") > F.col("msg")))
                     & (F.col("_edited").isNull() | (F.col("_edited") <= F.col("seq")))))
    parts = F.sort_array(F.collect_list(F.struct("seq", "role", "text")))
    return (alive.groupBy("conv_id", "msg").agg(parts.alias("p"))
            .select("conv_id", "msg",
                    F.coalesce(_last_role(F.col("p")), F.lit("")).alias("role"),
                    F.array_join(F.col("p.text"), "").alias("text")))


def _last_role(parts: Column) -> Column:
    named = F.filter(parts, lambda p: p["role"].isNotNull())
    return F.when(F.size(named) > 0, F.element_at(named, -1)["role"])


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask array<(start, length)>."""
    m = (messages.withColumn("_role", escape(F.col("role"))).withColumn("_text", escape(F.col("text")))
         .withColumn("_piece", F.concat(F.lit(OPEN), "_role", F.lit(MIDDLE), "_text", F.lit(CLOSE))))
    before = (Window.partitionBy("conv_id").orderBy("msg")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = (F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0))
             + len(OPEN) + F.length("_role") + len(MIDDLE))
    m = m.withColumn("_start", start.cast("long"))
    rows = F.sort_array(F.collect_list(F.struct(
        "msg", "_piece", "_start", F.length("_text").cast("long").alias("_length"),
        (F.col("role") == loss_role).alias("_loss"))))
    return m.groupBy("conv_id").agg(rows.alias("r")).select(
        "conv_id", F.array_join(F.col("r._piece"), "").alias("formatted"),
        F.transform(F.filter("r", lambda x: x["_loss"]),
                    lambda x: F.struct(x["_start"].alias("start"), x["_length"].alias("length"))).alias("loss_mask"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_turns(formatted: Column) -> Column:
    """array<(role, text)> read back from a rendered string."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(body, lambda b: F.struct(
        unescape(F.substring_index(b, MIDDLE, 1)).alias("role"),
        unescape(F.substr(b, F.length(F.substring_index(b, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text")))


def with_extra_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts consist of control strings."""
    extra = spark.sql("""SELECT bigint(-7) AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (bigint(0), 'user'), (bigint(1), 'assistant') AS t(turn, role)""")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def chat_report(chats: DataFrame) -> DataFrame:
    """The contract of op10, read back from the rendered output."""
    t = chats.withColumn("_t", read_turns(F.col("formatted")))
    turns = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(
        F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return t.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
