"""Chat logs as events, folded into messages and rendered for training.

A log has events: a message opens, streamed deltas add to it, an edit replaces its text, a
regeneration drops it and the branch that followed it: what later messages said before it is gone.
Events are gathered per message, which spreads even a conversation that holds most of the log; one row
per message then meets its conversation, to learn which branch it is on and to be rendered in
order. All of it is built-in expressions.

Rendered turn: `### role: text</turn>` and a line end. Inside roles and texts a backslash goes
before every backslash and `#`, before the slash of `</turn>` and, in roles, before a colon; so
no control string survives in them, and dropping one backslash before any character restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

#: Kinds of events, in the order in which events of equal sequence number apply.
OPEN, REGENERATE, EDIT, DELTA = "message", "regenerate", "edit", "delta"
KINDS = (OPEN, REGENERATE, EDIT, DELTA)


def escape(text: Column) -> Column:
    """Text without control strings."""
    doubled = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    """The text that `escape` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, message, role, text.

    `events` has conv_id, message (its number in the conversation), seq, kind, role, text. An event
    is void if an earlier message of the conversation is regenerated after it; a message without other events is
    not in the result. Of the others, the last message, edit or regenerate event sets the text; deltas after it
    add to it, in the order of seq, then of kind. The role is that of the latest event that has one. Null texts add
    nothing, unknown kinds have no effect, a repeated delta is added again, messages may lack
    their opening event. A null conv_id or message is a group of its own; a null message is the first of its conversation.
    """
    order = F.struct("seq", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"))
    named = events.filter(F.col("kind").isin(*KINDS)).select(
        "conv_id", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"), order.alias("at"))
    folded = named.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") == REGENERATE, F.col("at"))).alias("regenerated_at"),
        F.array_sort(F.collect_list(F.struct("at", "kind", "text", "role"))).alias("events"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("branch_at", F.max("regenerated_at").over(before))
    folded = folded.withColumn("events", F.filter("events", lambda e: F.col("branch_at").isNull() | (e["at"] > F.col("branch_at"))))
    folded = folded.filter(F.size("events") > 0).withColumns({
        "set_at": F.array_max(F.transform(F.filter("events", lambda e: e["kind"] != DELTA), lambda e: e["at"])),
        "roles": F.transform(F.filter("events", lambda e: e["role"].isNotNull()), lambda e: e["role"])})
    live = F.filter("events", lambda e: F.col("set_at").isNull() | (e["at"] >= F.col("set_at")))
    return folded.select("conv_id", "message", F.get("roles", F.size("roles") - 1).alias("role"),
                         F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render_conversations(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, loss_spans.

    Messages are ordered by number; a null role or text is empty. `segments` (text, loss) are
    `formatted` cut at the edges of the loss mask; `loss_spans` (start, length) say the same in
    code points. No messages give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(AFTER_ROLE))
    turns = messages.select("conv_id", "message", head.alias("head"), escape(text).alias("body"),
                            (role == loss_role).alias("loss"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start.cast("bigint"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("message", "head", "body", "loss", "start"))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")), F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(
        t["start"].alias("start"), F.length(t["body"]).cast("bigint").alias("length")))
    return rows.select("conv_id", segments.alias("segments"), spans.alias("loss_spans")).select(
        "conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of role and text, as they were before."""
    parts = F.split(formatted, END)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    head = r"(?s)^### ((?:[^:\\]|\\.)*+): "

    def parse(turn: Column) -> Column:
        return F.struct(unescape(F.regexp_extract(turn, head, 1)).alias("role"),
                        unescape(F.regexp_replace(turn, head, "")).alias("text"))

    return F.transform(turns, parse)


def turns_as_events(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """A log for a table with one row per turn, as a service might have written it.

    Each turn opens a message and streams a draft. Every other draft is replaced by an edit; the others are
    answered, and then regenerated, which drops the answer. The turn's own text follows in two deltas.
    Turns of equal number are ordered by role and text, and all are kept.
    """
    columns = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                           F.col(text).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.expr("length(text) div 2")
    none, edited = F.lit(None).cast("string"), F.col("message") % 2 == 0

    def event(kind: str, text: Column, role: Column = none, ahead: int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), role.alias("role"), F.lit(ahead).alias("ahead"))

    begun = [event(OPEN, none, F.col("role")), event(DELTA, F.lit("A draft of #"))]
    own = [event(DELTA, F.expr("substring(text, 1, length(text) div 2)")), event(DELTA, F.col("text").substr(half + 1, F.length("text")))]
    answered = [event(OPEN, F.lit("An answer"), F.lit("user"), 1), event(DELTA, F.lit(" to the draft"), none, 1)]
    kinds = F.when(edited, F.array(*begun, event(EDIT, F.lit("")), *own)).otherwise(
        F.array(*begun, *answered, event(REGENERATE, none), *own))
    return (columns.withColumn("message", number)
            .select("conv_id", "message", F.posexplode(kinds).alias("at", "event"))
            .select("conv_id", (F.col("message") + F.col("event.ahead")).alias("message"),
                    (F.col("message").cast("bigint") * 8 + F.col("at")).alias("seq"), "event.kind", "event.role", "event.text"))


def format_conversations(events: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Fold a log and render it; see `fold_events` and `render_conversations`."""
    return render_conversations(fold_events(events), loss_role)
