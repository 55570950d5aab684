r"""Chat formatting with a grammar round trip, with DataFrame functions only.

A turn is `<s>[INST] role [/INST] text</s>`. The parser cuts at `</s>`, takes the role up to the first ` [/INST] `
and the text behind it, rejects fields that hold a control string, and drops each backslash before another character.
Every turn is rendered as it is and reparsed; only a turn that does not come back identical has its content escaped
(backslashes doubled, one put behind the first character of each control string). The whole conversation is reparsed as
well; `proven` makes one that still differs an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"


def escaped(text: Column) -> Column:
    """Text without control strings that `unescaped` takes back to the original."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])(?=s>|/s>|INST\]|/INST\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parsed_piece(piece: Column) -> Column:
    """Struct (role, text) of a piece between two ends of turn, escapes taken back; null if it breaks the grammar."""
    body = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
    role = F.substring_index(body, MIDDLE, 1)
    text = F.substring(body, F.length(role) + len(MIDDLE) + 1, F.lit(2**31 - 1))
    valid = piece.startswith(OPEN) & body.contains(MIDDLE) & ~role.rlike(CONTROL) & ~text.rlike(CONTROL)
    return F.when(valid, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))


def parsed(formatted: Column) -> Column:
    """All turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parsed_piece)


def formatted_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, chat_no (order from 1), role, text, piece (its rendering, escaped only if it must be).

    Null role or text counts as empty. Turns are ordered by turn (null first), then role and text, so that repeated
    turn numbers have a fixed order too; repeated rows stay. Rows of a null conversation form one conversation.
    """
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw = rendered(F.col("role"), F.col("text"))
    back = parsed(raw)
    same = (F.size(back) == 1) & back[0]["role"].eqNullSafe(F.col("role")) & back[0]["text"].eqNullSafe(F.col("text"))
    piece = F.when(F.coalesce(same, F.lit(False)), raw).otherwise(rendered(escaped(F.col("role")), escaped(F.col("text"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return plain.withColumn("piece", piece).withColumn("chat_no", F.row_number().over(order))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in characters) and round_trip.

    round_trip says that the parser gives back every turn. loss_spans cover the texts of the role `learn` and nothing
    else. The turns of one conversation meet in one row, since they are one document; the window and the grouping share
    one shuffle. An empty table gives an empty result.
    """
    rows = formatted_turns(turns, conv_id, turn, role, text)
    order = Window.partitionBy("conv_id").orderBy("chat_no")
    end = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = F.locate(MIDDLE, F.col("piece")).cast("long") + len(MIDDLE) - 1
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("piece") + inner)
    span = F.struct("start", (F.col("end") - F.lit(len(CLOSE)) - F.col("start")).alias("length"))
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("chat_no", "piece", "role", "text", F.when(F.col("role") == learn, span).alias("span")))).alias("chat")
    )
    whole = gathered.withColumn("formatted", F.array_join(F.transform("chat", lambda x: x["piece"]), ""))
    source = F.transform("chat", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.filter(F.transform("chat", lambda x: x["span"]), lambda x: x.isNotNull())
    return whole.select("conv_id", "formatted", spans.alias("loss_spans"), (parsed(F.col("formatted")) == source).alias("round_trip"))


def proven(chats: DataFrame) -> DataFrame:
    """The conversations of format_chats; one that isn't read back as it was is an error, never a silent loss."""
    failed = F.raise_error(F.concat(F.lit("no round trip of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return chats.withColumn("formatted", F.when(F.coalesce("round_trip", F.lit(False)), F.col("formatted")).otherwise(failed))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, cut out of the formatted text by its spans and unescaped."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def read_chats(chats: DataFrame) -> DataFrame:
    """The conversations read back from `formatted` and `loss_spans`: conv_id, turns, loss_texts (unescaped), formatted."""
    text = F.col("formatted")
    return chats.select("conv_id", parsed(text).alias("turns"), loss_texts(text, F.col("loss_spans")).alias("loss_texts"), "formatted")
