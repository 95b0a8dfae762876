"""Chat formatting with typed content parts, built-in functions only.

A conversation is its turns in order of (turn, role, text); a turn is a list of parts. The visitor renders a text part
escaped and an image, audio or document part as an ordered placeholder, records its reference and how many tokens the
placeholder stands for, and marks what counts for the loss (the text parts of assistant turns).

Template, per turn: `<turn:ROLE>` parts `</turn>` newline; placeholders are `<image>`, `<audio>`, `<document>`. In roles and texts `~`, `<` and
`>` (roles only) become `~0`, `~1`, `~2`, so no text can hold a control string, and reading back undoes it exactly.

Defined results: null text or role is empty; repeated rows are turns of their own; a null conv_id is one conversation; unknown part
types count as text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings, and tokens per unit (image tile, second of audio, page) of the placeholders.
OPEN, CLOSE = "<turn:", "</turn>\n"
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLE = "assistant"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit(">"), F.lit("~2"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("~2"), F.lit(">")))


def text_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts from a table of plain texts."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.array(part).alias("parts"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, segments array<struct<text, loss>>, formatted, attachments array<struct<ordinal, type, ref, tokens>>, expanded_tokens.

    turns: conv_id, turn, role, parts array<struct<type, text, ref, units>>.
    """
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    is_media = lambda p: F.coalesce(p["type"].isin(list(UNIT_TOKENS)), F.lit(False))

    def visit(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
        parts = F.transform(
            F.coalesce(t["parts"], F.expr("array()").cast("array<struct<type:string,text:string,ref:string,units:bigint>>")),
            lambda p: F.struct(
                F.when(is_media(p), F.concat(F.lit("<"), p["type"], F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))).alias("text"),
                ((role == LOSS_ROLE) & ~is_media(p)).alias("loss"),
            ),
        )
        return F.concat(F.array(plain(F.concat(F.lit(OPEN), escape_role(role), F.lit(">")))), parts, F.array(plain(F.lit(CLOSE))))

    media = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), is_media)
    tokens = lambda p: F.coalesce(p["units"], F.lit(0)) * F.coalesce(*(F.when(p["type"] == k, F.lit(v)) for k, v in UNIT_TOKENS.items()))
    rows = ordered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", visit)).alias("segments"),
        F.transform(media, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens"))).alias("attachments"),
    )
    return rows.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from the formatted string alone (placeholders stay as they stand)."""
    turns = F.split(formatted, "</turn>\n")

    def turn(seg: Column) -> Column:
        head = F.substring_index(F.substr(seg, F.lit(len(OPEN) + 1)), ">", 1)
        return F.struct(unescape_role(head).alias("role"), unescape(F.substr(seg, F.length(head) + len(OPEN) + 2)).alias("text"))

    return F.transform(F.filter(turns, lambda s: s != ""), turn)


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted output says of itself: turns and loss text, read back."""
    rows = chats.select("conv_id", "segments", "formatted", read_back(F.col("formatted")).alias("read"))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    rows = rows.select("conv_id", "formatted", F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), loss.alias("loss"))
    return rows.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
