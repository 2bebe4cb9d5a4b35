"""Chat formatting: rebuild final messages from an event log, then render them with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template. Texts never hold a bare "<", so no text can open or close a turn.
OPEN, CLOSE = '<turn role="', "</turn>\n"
#: Escapes, applied in this order and undone in the opposite one.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))
#: Events that clear a turn and everything after it.
RESETS = ("edit", "regenerate")
GROWING = (*RESETS, "delta")


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def events_from_turns(turns: DataFrame) -> DataFrame:
    """A table of whole turns as an event log: each row is a ``message`` event, in order of its turn."""
    return turns.select(
        F.col("conv_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn"), F.col("role"), F.col("text")
    )


def drafted_log(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A table of whole turns as the log of how they may have come about; folded, it gives the table's turns back.

    Every row is written twice. A row of the roles in ``learn`` streams a draft, is regenerated, and streams its text in two
    deltas; another row is sent as a draft and edited. Before that, each draft has been answered by a turn that the reset has to
    drop. Rows keep the order of turn, role and text inside their conversation, which is their turn in the log.

    NULL text and role are empty, repeated rows are turns of their own, NULL conversations are one conversation, an
    empty table gives an empty log.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(
        "conv_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.row_number().over(order) - 1).cast("bigint").alias("turn"),
    )
    text, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substr(text, F.lit(1), half), F.substr(text, half + 1)

    def event(step: int, kind: str, said: Column, later: int = 0) -> Column:
        return F.struct(
            (F.col("turn") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), (F.col("turn") + later).alias("turn"), F.col("role").alias("role"), said.alias("text")
        )

    answer = event(1, "message", F.concat(F.lit("re: "), tail), 1)
    streamed = F.array(event(0, "delta", F.concat(tail, head)), answer, event(2, "regenerate", F.lit("")), event(3, "delta", head), event(4, "delta", tail))
    edited = F.array(event(0, "message", F.concat(tail, head)), answer, event(2, "edit", text))
    events = F.when(F.col("role").isin(*learn), streamed).otherwise(edited)
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, text): the messages that stand at the end of each conversation's log.

    ``events``: conv_id, seq, kind, turn, role, text. In order of ``seq`` (ties by kind,
    turn, role, text): ``message`` adds a whole message of its own, also when its turn
    number repeats; ``delta`` appends to its turn; ``edit`` puts its text in place of its
    turn and drops all later turns; ``regenerate`` empties its turn and drops all later
    ones, and the deltas after it fill the turn again. An event counts unless a later
    reset names its turn or an earlier one, which one running minimum over the log in
    reverse tells. A NULL or other kind counts as ``message``, a NULL text or role as
    empty, a NULL turn as before all others. Repeated rows are messages of their own.
    """
    kind = F.when(F.col("kind").isin(*GROWING), F.col("kind")).otherwise("message")
    log = events.select(
        F.col("conv_id"),
        F.col("seq"),
        kind.alias("kind"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    back = Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in ("seq", "kind", "turn", "role", "text")])
    reset = F.when(F.col("kind").isin(*RESETS), F.col("turn"))
    seen = log.withColumns(
        {
            "place": -F.row_number().over(back),
            "cleared": F.min(reset).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    standing = seen.filter(F.col("cleared").isNull() | (F.col("turn") < F.col("cleared")))
    own = F.when(F.col("kind") == "message", F.col("place")).otherwise(F.lit(0))
    pieces = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    folded = standing.groupBy("conv_id", "turn", own.alias("own")).agg(pieces.alias("pieces"))
    return folded.select(
        "conv_id",
        "turn",
        F.col("pieces")[0]["place"].alias("place"),
        F.coalesce(F.get(F.filter("pieces", lambda p: p["role"] != ""), F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments): each conversation as one text and the same text cut at the borders of the loss mask.

    ``segments`` is an array of (piece, loss) whose pieces join to ``formatted``; ``loss``
    marks the texts of the roles in ``learn``. One row holds a conversation, as the
    format asks; nothing larger meets in one place.
    """
    turn = F.sort_array(F.collect_list(F.struct("turn", "place", "role", "text")))
    cut = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit('">')).alias("piece"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("piece"), t["role"].isin(*learn).alias("loss")),
                F.struct(F.lit(CLOSE).alias("piece"), F.lit(False).alias("loss")),
            ),
        )
    )
    segments = messages.groupBy("conv_id").agg(turn.alias("turns")).select("conv_id", cut.alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    blocks = F.array_remove(F.split(formatted, CLOSE), "")

    def parse(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), '">', 1)
        text = F.substr(block, F.length(role) + F.lit(len(OPEN) + 3))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, parse)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["piece"]), ""))


def digest_chats(chats: DataFrame) -> DataFrame:
    """Counts and digests that are read back from rendered conversations."""
    turns = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("segments")).alias("learned"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
