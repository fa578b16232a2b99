"""Conversations as one marked text each, proven by reading the text back.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. The text of a
conversation is its turns in order, nothing between. Reading needs no look-ahead:
split after each end mark, then each piece is a start mark, a role up to the first
line break, and a text; marks anywhere else are an error. Control strings inside a
text carry backslashes after their ``<`` and the reader takes one away, so a text
that already looks escaped is kept apart from one that was escaped.

Every turn is first written as it is and read back. A turn that does not come back
as it was (it holds a mark, or something that looks like an escaped one, or its
role holds a line break or backslash) is escaped and read back again; a turn that
still differs would end the job. Turns are checked on their own, before any shuffle,
because the reader is in its first state again after each of them; a finished
conversation is then read as a whole and must fall into exactly its turns.

Defined results: null texts and roles are empty ones; turns stand by ``turn`` (null
first), equal ones by role, then by their written form; repeated rows are repeated
turns; rows with a null id are one conversation with a null id; an empty table gives
no rows. Columns other than the four named are not read. A conversation is one
row of output, so its text is held in one row; nothing else is gathered. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CLOSE = END + "\n"
_CLOSE_PATTERN = r"<\|im_end\|>\n"
_ESCAPE = (r"<(\\*)\|(im_start|im_end)\|>", r"<\\$1|$2|>")
_RESTORE = (r"<\\(\\*)\|(im_start|im_end)\|>", "<$1|$2|>")
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    """One backslash more in everything that is a mark or looks like an escaped one."""
    return F.regexp_replace(text, *_ESCAPE)


def restore(text: Column) -> Column:
    """What the reader makes of a text: one backslash less."""
    return F.regexp_replace(text, *_RESTORE)


def escape_role(role: Column) -> Column:
    """A role without line breaks and marks: ``\\``, line break and ``|`` get names."""
    role = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(role, F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def restore_role(role: Column) -> Column:
    def names(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))

    # Pairs of backslashes first, from the left, so that none is taken for a name.
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), names), "\\")


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(CLOSE))


def _read_turn(piece: Column) -> Column:
    """The turn in a piece (without its end mark), or null if it is none."""
    body = F.substring(piece, len(START) + 1, 2**31 - 1)
    stop = F.instr(body, "\n")
    sound = (piece.startswith(START) & (stop > 0)
             & ~body.contains(START) & ~body.contains(END))
    return F.when(sound, F.struct(
        restore_role(F.left(body, stop - 1)).alias("role"),
        restore(F.substring(body, stop + 1, F.length(body))).alias("text")))


def pieces(formatted: Column) -> Column:
    """The formatted text cut after each end mark, end marks left out. Text after the
    last one is an error: a lone end mark, which no turn can be, stands for it."""
    cut = F.split(formatted, _CLOSE_PATTERN, -1)
    closed = F.slice(cut, F.lit(1), F.size(cut) - 1)
    return F.when(F.element_at(cut, -1) == "", closed).otherwise(F.concat(closed, F.array(F.lit(END))))


def parse(formatted: Column) -> Column:
    """The turns (array of ``role``, ``text``) in a formatted text; null for each piece
    that breaks the grammar."""
    return F.transform(pieces(formatted), _read_turn)


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_roles=LOSS_ROLES) -> DataFrame:
    """Per row: ``conv``, ``turn``, ``role``, ``formatted``, and ``start`` and ``chars`` of
    what is learnt within ``formatted`` (code points; null for other roles)."""
    source = rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")

    def comes_back(r: str, t: str) -> Column:
        return parse(written(F.col(r), F.col(t))) == F.array(F.struct(role.alias("role"), text.alias("text")))

    tried = source.withColumn("_plain", F.coalesce(comes_back("role", "text"), F.lit(False)))
    for name, safe in (("role", escape_role), ("text", escape)):
        tried = tried.withColumn(f"_{name}", F.when(F.col("_plain"), F.col(name)).otherwise(safe(F.col(name))))
    fits = F.col("_plain") | F.coalesce(comes_back("_role", "_text"), F.lit(False))
    learnt = role.isin(list(loss_roles))
    return tried.select(
        "conv", "turn", "role",
        F.when(fits, written(F.col("_role"), F.col("_text"))).otherwise(
            F.raise_error(F.lit("a turn does not read back as it was"))).alias("formatted"),
        F.when(learnt, F.length("_role") + len(START) + 1).alias("start"),
        F.when(learnt, F.length("_text")).alias("chars"))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_roles=LOSS_ROLES) -> DataFrame:
    """Per conversation: its id, ``n_turns``, ``formatted``, and ``loss_mask``: for each
    turn the ``start`` and ``chars`` of what is learnt, counted in code points from the
    turn's own start mark, or null."""
    turns = format_turns(rows, conv_col, turn_col, role_col, text_col, loss_roles)
    held = turns.groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("turn", "role", "formatted", "start", "chars"))).alias("held"))
    joined = held.select(
        "conv", F.transform("held", lambda t: t["formatted"]).alias("parts"),
        F.transform("held", lambda t: F.when(t["start"].isNotNull(), F.struct(t["start"], t["chars"])))
        .alias("loss_mask")).withColumn("formatted", F.array_join("parts", ""))
    whole = F.transform(pieces(F.col("formatted")), lambda p: F.concat(p, F.lit(CLOSE))) == F.col("parts")
    return joined.select(
        F.col("conv").alias(conv_col), F.size("parts").cast("long").alias("n_turns"),
        F.when(whole, F.col("formatted")).otherwise(
            F.raise_error(F.lit("a conversation does not fall into its turns"))).alias("formatted"),
        "loss_mask")


def read_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` rows (of ``format_chats``) with ``turns`` read back by the parser and
    ``loss_text``: all text under the loss mask, unescaped, nothing between."""
    under = F.transform(
        F.arrays_zip(pieces(F.col("formatted")).alias("piece"), F.col("loss_mask").alias("mask")),
        lambda z: F.coalesce(restore(F.substring(z["piece"], z["mask"]["start"] + 1, z["mask"]["chars"])), F.lit("")))
    return formatted.withColumns({"turns": parse(F.col("formatted")), "loss_text": F.array_join(under, "")})


def chat_digests(rows: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """Per conversation: id, and digests of what ``read_chats`` finds in the output."""
    back = read_chats(format_chats(rows, conv_col, **columns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
