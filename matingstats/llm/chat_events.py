"""Operator 6: chat formatting from an event log.

A log row is one event of a conversation: ``message`` (a whole message), ``delta`` (a
streamed piece that is appended to a message), ``edit`` and ``regenerate`` (the
message starts anew with this text). Logs are partitioned by conversation and sorted by
sequence number. Per message only what follows its last edit or regeneration counts; an edit or regeneration
also discards what was logged before it for later messages, as the old branch of the
talk. The rest is folded into final messages and rendered.

The fold is relational: one shuffle on the conversation serves the numbering, the fold of
each message and the window over messages. Nothing is rebuilt per event, so its cost is
linear in the log. A conversation's rendered text is one value, hence one row.

Template: a turn is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and
texts get a backslash after their first character; those that already have
backslashes there get one more, which makes the escape reversible.

Defined results: a null text or role counts as empty; a null sequence number sorts first;
events that tie in sequence sort by message, kind, role and text; repeated rows of a turn
table are messages of their own; a conversation whose events were all discarded is absent; a null conversation
id is a conversation; an empty log gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matingstats.llm.common import sql_string

_MARKED = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"

EVENTS = "conv_id, seq, message, kind, role, text"


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    return F.regexp_replace(text, _MARKED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def events_from_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A table with a row per turn as a log: each row is one whole message."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), "role", "text") \
        .select("conv_id", n.alias("seq"), n.alias("message"), F.lit("message").alias("kind"), "role", "text")


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log with the columns ``EVENTS``."""
    event = F.struct(F.coalesce(F.col("seq"), F.lit(-(1 << 62))).alias("seq"), F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
                     F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    per_message = (log.groupBy("conv_id", "message")
                   .agg(F.array_sort(F.collect_list(event)).alias("events"),
                        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset")))
    before = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    live = (per_message.withColumn("cut", F.max("reset").over(before))
            .withColumn("events", F.expr("filter(events, e -> cut IS NULL OR e.seq > cut)"))
            .where("size(events) > 0"))
    # the last event that starts the message anew; deltas before it are gone
    start = F.expr("array_max(transform(events, (e, i) -> IF(e.kind = 'delta', 0, i)))")
    return (live.withColumn("start", start).withColumn("tail", F.expr("slice(events, start + 1, size(events))"))
            .select("conv_id", "message",
                    F.expr("coalesce(get(filter(events, e -> e.role != ''), 0).role, '')").alias("role"),
                    F.expr("array_join(transform(tail, e -> e.text), '')").alias("text")))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted and segments.

    ``segments`` (text, loss) are the pieces of ``formatted`` in order; the loss mask covers
    those with ``loss`` true: the texts of turns whose role is in ``loss_roles``.
    """
    roles = ", ".join(map(sql_string, loss_roles)) or "NULL"
    turns = messages.select("conv_id", F.struct("message", "role", escape(F.col("role")).alias("head"),
                                                escape(F.col("text")).alias("text")).alias("t"))
    segments = F.expr(f"""flatten(transform(turns, t -> array(
        named_struct('text', concat('<s>[INST]', t.head, '[/INST]'), 'loss', false),
        named_struct('text', t.text, 'loss', coalesce(t.role IN ({roles}), false)),
        named_struct('text', '</s>', 'loss', false))))""")
    return (turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
            .select("conv_id", segments.alias("segments"))
            .select("conv_id", F.expr("array_join(transform(segments, s -> s.text), '')").alias("formatted"), "segments"))


def read_back(rendered: DataFrame) -> DataFrame:
    """The turns and the loss texts that the rendered output holds: adds turns (role, text) and loss_texts."""
    un = lambda x: f"regexp_replace({x}, {sql_string(_ESCAPED)}, '$1$2$3')"
    turns = F.expr(f"""transform(slice(split(formatted, '</s>', -1), 1, greatest(size(split(formatted, '</s>', -1)) - 1, 0)),
        p -> named_struct('role', {un("substring_index(substr(p, 10), '[/INST]', 1)")},
                          'text', {un("substr(p, locate('[/INST]', p) + 7)")}))""")
    loss = F.expr(f"transform(filter(segments, s -> s.loss), s -> {un('s.text')})")
    return rendered.withColumn("turns", turns).withColumn("loss_texts", loss)


def format_chats(log: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Event log to rendered conversations (conv_id, formatted, segments)."""
    return render(reconstruct(log), loss_roles)

