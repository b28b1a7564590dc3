"""Chat logs folded from events and rendered with a loss mask, by DataFrame functions only.

Events carry (conv_id, seq, op, role, text, ref).  Ordered by seq within a conversation they are folded:

- ``message`` starts the next message, with role and text;
- ``delta`` appends text to the current message, or to message number ``ref`` (from 0, dropped ones count);
- ``edit`` replaces that message's text;
- ``regenerate`` starts that message's text anew and drops all later messages begun before it.

The current message is the one begun last, or regenerated since then: what is streamed after a ``regenerate`` goes to
the regenerated message until the next one begins.

The fold is a running count, a group-by of (conversation, message) and a running minimum over what follows;
then each message is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts ``\\``
becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no text can hold a control string and the
escape can be undone; a line break in a role becomes ``\\n``.  ``loss_spans`` are the places of
the assistant texts in the formatted string.  A conversation's rows meet in one row, its own output.

Defined results: null texts and roles are empty; a null op is ``message``; events before the first message
and with a ref to no message are ignored; a very long text is one value of its row, never cut; events with equal seq are ordered by op, role and text, equal
ones are all applied; null conversation ids are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # a line break is \n behind an even number of backslashes: doubled ones are set aside first
    kept = F.replace(role, F.lit("\\\\"), F.lit("<|"))  # escaped roles hold no <|
    kept = F.replace(F.replace(kept, F.lit("<\\|"), F.lit("|<|>|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(F.replace(kept, F.lit("|<|>|"), F.lit("\x00")), F.lit("<|"), F.lit("\\")), F.lit("\x00"), F.lit("<|"))


def as_events(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text): each row is a message event."""
    c = conversations
    return c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("seq"), F.lit("message").alias("op"), c["role"].alias("role"), c["text"].alias("text"), F.lit(None).cast("long").alias("ref"))


def fold(events: DataFrame) -> DataFrame:
    """events -> (conv_id, position, role, text): the final messages."""
    e = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("ref").cast("long").alias("ref"))
    order = Window.partitionBy("conv_id").orderBy("seq", "op", "role", "text")
    e = e.withColumn("n", F.row_number().over(order))
    run = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("m", F.count_if(F.col("op") == "message").over(run) - 1)
    starts = F.col("op") == "message"
    now = F.when(starts, F.col("m")).when((F.col("op") == "regenerate") & F.col("ref").between(0, F.col("m")), F.col("ref"))
    e = e.withColumn("now", F.last(now, True).over(run))
    e = e.withColumn("to", F.when(starts, F.col("m")).otherwise(F.coalesce("ref", "now"))).where("`to` between 0 and m")
    rest = Window.partitionBy("conv_id").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("cut", F.min(F.when(F.col("op") == "regenerate", F.col("to"))).over(rest))
    base = F.col("op").isin("message", "edit", "regenerate")
    # what an edit or a new generation replaces is dropped before texts are gathered
    own = Window.partitionBy("conv_id", "to").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("stale", F.count_if(base).over(own) > 0)
    kept = e.groupBy("conv_id", "to").agg(
        F.max(F.when(starts, F.col("role"))).alias("role"),
        F.min(F.when(starts, F.coalesce(F.col("cut") < F.col("to"), F.lit(False)))).alias("dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("stale"), F.struct("n", "text")))), lambda x: x["text"]), "").alias("text"),
    )
    return kept.where("not dropped").select("conv_id", F.col("to").alias("position"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, position, role, text) -> (conv_id, formatted, loss_spans array<struct<start, length>>).

    Starts count code points from 0.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "position", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    parts = parts.withColumn("start", begin)
    span = F.struct(F.col("start"), F.length("body").cast("long").alias("length"))
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "piece", "loss", span.alias("span")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: r["span"]).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """events -> (conv_id, formatted, loss_spans)."""
    return render(fold(events))


def read_back(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    bodies = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))

    def turn(p):
        at = F.locate("\n", p)
        return F.struct(_unescape_role(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(F.substring(p, at + 1, F.length(p))).alias("text"))

    return F.transform(bodies, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, cut out of the formatted string."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
