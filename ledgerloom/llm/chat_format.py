r"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, message, seq, op, role, text), where message orders the turns of a
conversation and seq the events:

* delta: appends its text to the message (streaming);
* edit: replaces the message's text so far;
* regenerate: replaces it too, and voids what later messages of the conversation held before it.

Events are folded per message, voided through a running maximum over the conversation's messages,
and rendered as `<|im_start|>role\ntext<|im_end|>\n` per turn, with a loss flag for each turn.

Escaping: in texts a backslash is put before the bar of `<|`, `<\|`, `<\\|` and so on; taking one
away restores the text. In roles `%` and newline become %25 and %0A. Neither leaves a `<|` that
the template did not write, so rendered text splits back into its turns without loss.

Null texts and roles are empty, a null op is a delta, events equal in seq are ordered by op, role
and text, repeated rows count each time, an empty log gives no conversations. Null conv_ids are one
conversation of their own, null messages and turns come first; other columns are left out, whatever
their names. A rendered conversation is one value, so its turns meet in one row, and one whose text passes 2 GB fails
the job; nothing before that gathers more than a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<$1\\|"))


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit(r"<$1|"))


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape_text(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log; messages with no event left are gone."""
    void = F.col("op").isin("edit", "regenerate")
    events = events.select("conv_id", "message", "seq", F.coalesce("op", F.lit("delta")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "message").agg(
        F.collect_list(F.struct("seq", "op", "role", "text")).alias("log"),
        F.max(F.when(void, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regenerated"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("voided", F.max("regenerated").over(earlier))
    live = F.filter("log", lambda e: (F.col("reset").isNull() | (e.seq >= F.col("reset"))) & (F.col("voided").isNull() | (e.seq > F.col("voided"))))
    messages = messages.select("conv_id", "message", F.sort_array(live).alias("log")).where(F.size("log") > 0)
    return messages.select("conv_id", "message", F.element_at("log", -1).role.alias("role"), F.array_join(F.transform("log", lambda e: e.text), "").alias("text"))


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (for each turn, whether its text is trained on)."""
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    text = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"), escape_text(t.text), F.lit(END)))
    return turns.select("conv_id", F.array_join(text, "").alias("formatted"), F.transform("turns", lambda t: t.role.isin(*trained_roles)).alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """rendered with turns array<struct<role, text, loss>>, parsed from the formatted text and its mask."""
    body = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(body, F.lit(1), F.size(body) - 1)

    def turn(piece, i):
        cut = F.instr(piece, F.lit("\n"))
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
            unescape_text(F.substring(piece, cut + 1, F.length(piece))).alias("text"),
            F.get("loss_mask", i).alias("loss"),
        )

    return rendered.withColumn("turns", F.transform(pieces, turn))


def conversation_events(conversations: DataFrame, pieces: int = 4, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a chat that streams: what fold_events makes of it are these rows.

    Every row is a message of its own, and all events of a conversation are numbered in one sequence. A draft, the
    first piece, is streamed; once the next message's draft has been streamed too, the message is replaced
    and its pieces follow as deltas. Trained roles are replaced by a regeneration, which voids the draft after
    it; that one is then streamed again without a replacement of its own, and other messages are edited.
    Events come in no order but their seq.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    stride = pieces + 2
    text, size = F.coalesce("text", F.lit("")), F.ceil(F.length(F.coalesce("text", F.lit(""))) / F.lit(pieces)).cast("int")
    trained = F.coalesce(F.col("role").isin(*trained_roles), F.lit(False))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("k", F.row_number().over(order).cast("long") * stride).withColumn("void", F.coalesce(F.lag(trained).over(order), F.lit(False)))
    event = lambda seq, op, text: F.struct((F.col("k") + seq).alias("seq"), op.alias("op"), text.alias("text"))
    piece = lambda i: F.substring(text, F.lit(i) * size + 1, size)
    delta = F.lit("delta")
    replaced = F.when(trained, event(stride + 1, F.lit("regenerate"), F.lit(""))).when(~F.col("void"), event(stride + 1, F.lit("edit"), F.lit("")))
    log = F.array_compact(F.array(event(0, delta, piece(0)), replaced, *[event(stride + 2 + i, delta, piece(i)) for i in range(pieces)]))
    messages = rows.select("conv_id", F.struct("turn", "k").alias("message"), "role", log.alias("log"))
    return messages.select("conv_id", "message", "role", F.inline("log")).select("conv_id", "message", "seq", "op", "role", "text")


def format_digests(rendered: DataFrame) -> DataFrame:
    """What op1 reports, all read back from the rendered text."""
    read = read_back(rendered)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.loss), lambda t: t.text), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
