"""Chat formatting in budgeted windows.

Turns of a conversation are ordered and a prefix sum of their token counts cuts
them into turn-aligned spans (see :func:`format_windows`).  Each span becomes one
training window made of the system turn (the
conversation's first turn, if its role is ``system``), the last turns of the span
before that fit ``history`` tokens, and the span's own turns.  Only the span's own
assistant turns are under the loss mask; what is repeated is masked, so every
assistant turn is a target once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a backslash is
put before every backslash and between ``<`` and ``|``, and in roles before every
line break, so control strings occur only where the template writes them; dropping each backslash and keeping the
character after it restores the text.

A null text or role is empty.  Turns with equal numbers follow by role and text;
null turn numbers come first.  Conversations with a null id form one
conversation.  System turn, history and own turns together fit the budget.  Only a
turn that does not fit it beside the system turn makes a longer window: whole, with
no other turn but the system turn.  A table without rows gives no windows.  A
conversation is the unit of order: its turns meet in one task for the prefix sum,
streamed and spilled by the window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 1024
HISTORY = 256
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def estimated_tokens(text: Column) -> Column:
    """Default token count of a turn: a token per four bytes, and four for the marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def escape_role(role: Column) -> Column:
    """A line break in a role is escaped too, since the first plain one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """``(conv_id, window, formatted, turns, repeated, loss)`` per window: ``turns``
    counts its turns, the first ``repeated`` of which an earlier window has
    as own turns; ``loss`` lists code-point spans ``(start, length)`` of
    ``formatted`` under the loss mask.

    The prefix sum is cut at multiples of a room, which is what system turn and history
    leave of the budget.  Turns between two cuts share a span.  A turn across a cut joins
    the span after it if the room holds both, else it is a span of its own, with as much
    history as still fits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("no"), role.alias("role"), escape(text).alias("body"),
                        tokens(text).alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("no").asc_nulls_first(), "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", F.row_number().over(order))
    is_system = (F.col("pos") == 1) & (F.col("role") == "system")
    # the system turn is in every window: it takes no room in the prefix sum
    rows = rows.withColumn("system", is_system).withColumn("size", F.when(is_system, F.lit(0)).otherwise(F.col("tokens")))
    rows = rows.withColumn("through", F.sum("size").over(upto))
    rows = rows.withColumn("before", F.col("through") - F.col("size"))
    beside = F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).over(upto)
    rows = rows.withColumn("free", F.greatest(F.lit(budget) - beside, F.lit(0)))
    # a long system turn leaves half of the rest to the own turns
    rows = rows.withColumn("room", F.greatest(
        F.col("free") - F.least(F.lit(history), F.floor(F.col("free") / 2)), F.lit(1)))
    rows = rows.withColumn("cell", F.floor(F.greatest(F.col("through") - 1, F.col("before")) / F.col("room")).cast("long"))
    rows = rows.withColumn("apart", (F.floor(F.col("before") / F.col("room")) < F.col("cell"))
                           & (F.sum("size").over(Window.partitionBy("conv_id", "cell")) > F.col("room")))
    span = F.col("cell") * 2 + F.when(F.col("apart"), 0).otherwise(1)
    fits = F.greatest(F.col("free") - F.when(F.col("apart"), F.col("size")).otherwise(F.col("room")), F.lit(0))
    rows = rows.withColumn("recall", F.least(F.lit(history), fits))
    rows = rows.withColumn("span", F.when(F.col("system"), F.lit(None)).otherwise(span))
    rows = rows.withColumn("opens", ~F.col("system") & ~F.col("span").eqNullSafe(F.lag("span").over(order)))
    # read from the end, so that the frame only grows: one that starts at each row is summed anew for each
    later = Window.partitionBy("conv_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("opens"), F.struct("span", "before", "recall")), ignorenulls=True).over(later)
    rows = rows.withColumn("next", nxt)
    # history: turns of a span whose tokens up to the next span's start fit
    recalled = ~F.col("system") & F.col("next").isNotNull() & (F.col("next.span") > F.col("span")) \
        & (F.col("next.before") - F.col("before") <= F.col("next.recall"))
    # the row that opens a span brings the system turn along
    lead = F.first(F.struct("role", "body")).over(upto)
    rows = rows.withColumn("lead", F.when(F.col("opens"), lead))
    rows = rows.withColumn("repeats", F.lag("span").over(order).isNotNull())
    rows = rows.withColumn("alone", F.col("system") & F.lead("pos").over(order).isNull())

    def entry(window, repeated, pos, role, body):
        return F.struct(window.cast("long").alias("window"), repeated.alias("repeated"), pos.alias("pos"),
                        role.alias("role"), body.alias("body"))

    turn = (F.col("pos"), F.col("role"), F.col("body"))
    leading = entry(F.col("span"), F.col("repeats"), F.lit(1), F.col("lead.role"), F.col("lead.body"))
    rows = rows.withColumn("at", F.explode(F.array_compact(F.array(
        F.when(~F.col("system"), entry(F.col("span"), F.lit(False), *turn)),
        F.when(recalled, entry(F.col("next.span"), F.lit(True), *turn)),
        F.when(F.col("opens") & (F.col("lead.role") == "system"), leading),
        F.when(F.col("alone"), entry(F.lit(0), F.lit(False), *turn))))))
    rows = rows.select("conv_id", "at.*")
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    piece = F.struct("pos", "repeated", target.alias("target"),
                     F.char_length(head).alias("head"), F.char_length("body").alias("chars"),
                     F.concat(head, "body", F.lit(END + "\n")).alias("piece"))
    windows = (rows.groupBy("conv_id", "window")
               .agg(F.sort_array(F.collect_list(piece)).alias("p")))       # one window's turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    loss = F.aggregate("p", start, lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["piece"])).alias("at"),
        F.when(x["target"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + x["head"]).alias("start"), x["chars"].alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return windows.select("conv_id", "window", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
                          F.size("p").alias("turns"), F.size(F.filter("p", lambda x: x["repeated"])).alias("repeated"),
                          loss["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Parses a window back: an array of ``(role, text)``."""
    bodies = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    inner = lambda x: F.substring(x, F.lit(1), F.char_length(x) - len(END) - 1)
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(bodies, lambda x: F.struct(unescape(F.regexp_extract(inner(x), head, 1)).alias("role"),
                                                  unescape(F.regexp_extract(inner(x), head, 2)).alias("text")))


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say, read back per conversation."""
    turns = F.slice(read_turns(F.col("formatted")), F.col("repeated") + 1, F.col("turns"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    # the system turn is an own turn of the first window only, where it leads
    each = windows.select("conv_id", "window", (F.col("turns") - F.col("repeated")).alias("own"), said.alias("said"),
                          under.alias("under"), F.char_length("formatted").cast("long").alias("chars"))
    conv = each.groupBy("conv_id").agg(
        F.sum("own").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "under"))).alias("w"))
    text = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return conv.select("conv_id", "n_turns", F.sha2(text("said"), 256).alias("turns_sha256"),
                       F.char_length(text("under")).cast("long").alias("loss_chars"),
                       F.sha2(text("under"), 256).alias("loss_sha256"), "formatted_chars")
