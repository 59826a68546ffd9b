"""Operator 3, chat formatting: a grammar round trip. DataFrame functions only.

Grammar of a formatted conversation:

    conversation = { turn }
    turn         = "### " role ": " text "</turn>" newline

It is read from left to right: a backslash makes the next character literal, whatever it is, so a control
string counts only if none of its characters is; a turn ends at the first close, its role at the first middle
(a role holds neither, a text no close).
A piece that does not begin with the opening, has no middle or is not closed is no turn.

The parser hides each backslash and the character after it behind two characters that no control string
has, splits what is left at the control strings, and takes roles and texts from the places found.

Each turn is first rendered as it stands and reparsed; where the parser does not give back exactly the
source turn (a control string or a backslash inside), the turn is rendered again with the conflicting
content escaped, a level stronger each time, until it does. The whole conversation is then reparsed and
compared with the source turns; a difference that is left stops the job, so nothing false is written.

Levels: 0 as it stands; 1 backslashes and the control strings broken by a backslash; 2 a backslash
before every character that occurs in any control string.

Defined cases: a null text is empty, a null role is empty; null turn numbers come first; repeated rows
and ties in the turn number are kept, ordered by role and text; rows with a null conversation id form
one conversation; an empty table gives no rows; other columns are ignored. A conversation is one
string by contract, so its turns meet in one row; they are rendered before they are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import cut, let, pieces, sums_before, text_of

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    if level == 1:
        x = F.regexp_replace(text, r"\\", r"\\\\")
        x = F.regexp_replace(x, r"<(?=/turn>)", r"<\\")
        x = F.regexp_replace(x, r"#(?=## )", r"#\\")
        return F.regexp_replace(x, r":(?= )", r":\\")
    return F.regexp_replace(text, r"([\\<>/#: \nturn])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns (role, text as written, escapes included) of a formatted conversation: array of structs.

    A piece that is no turn has the role null.
    """
    hidden = F.regexp_replace(formatted, r"(?s)\\.", "xx")  # the same places

    def turns(ends: Column, parts: Column, at: Column) -> Column:
        def turn(p: Column, i: Column) -> Column:
            head = F.instr(p, MID)
            good = p.startswith(OPEN) & (head > 0) & (i < F.size(ends) - 1)
            return F.struct(F.when(good, cut(parts, at[i] + len(OPEN), at[i] + head - 1)).alias("role"),
                            cut(parts, at[i] + F.when(good, head - 1 + len(MID)).otherwise(0), at[i] + F.char_length(p)).alias("text"))

        found = F.transform(ends, turn)
        # after the last close there is nothing, or a piece that is not closed
        return F.slice(found, 1, F.size(ends) - F.when(F.element_at(ends, -1) == "", 1).otherwise(0))

    return let(F.split(hidden, CLOSE, -1), lambda ends: let(pieces(formatted), lambda parts: let(
        sums_before(F.transform(ends, lambda p: F.char_length(p) + len(CLOSE))), lambda at: turns(ends, parts, at))))


def plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (role, text as reparsed from ``formatted``) and
    ``loss_mask``: the places (start, length, in characters of ``formatted``) of the texts under the loss."""
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(F.col(role_col)).alias("role"), text_of(F.col(text_col)).alias("text"))
    source = F.array(F.struct("role", "text"))
    tried = [render_turn(escape(F.col("role"), k), escape(F.col("text"), k)) for k in range(3)]
    good = [plain(parse(x)) == source for x in tried]
    t = t.withColumn("line", F.when(good[0], tried[0]).when(good[1], tried[1]).otherwise(tried[2]))
    c = t.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("t"))
    c = c.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
                 F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"))
    c = c.withColumn("parsed", parse(F.col("formatted")))
    c = c.withColumn("turns", plain(F.col("parsed")))
    same = F.assert_true(F.col("turns") == F.col("source"), F.lit("a conversation does not survive the round trip"))
    # places of the texts: each turn is opening, role, middle, text, close
    size = lambda x: F.char_length(x["role"]) + F.char_length(x["text"]) + len(OPEN) + len(MID) + len(CLOSE)
    here = lambda at: F.transform("parsed", lambda x, i: F.struct(
        x["role"].alias("role"), (at[i] + 1 + len(OPEN) + F.char_length(x["role"]) + len(MID)).alias("start"), F.char_length(x["text"]).alias("length")))
    places = let(sums_before(F.transform("parsed", size)), here)
    mask = F.transform(F.filter(places, lambda x: unescape(x["role"]) == loss_role), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return c.select(F.col("conv").alias(conv_col), "formatted", "turns", mask.alias("loss_mask"), same.alias("checked")).filter(F.col("checked").isNull()).drop("checked")


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return let(pieces(formatted), lambda parts: F.array_join(F.transform(mask, lambda m: unescape(cut(parts, m["start"] - 1, m["start"] - 1 + m["length"]))), ""))
