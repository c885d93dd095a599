"""Chat formatting in Spark expressions only: template, loss spans and the way back.

Turns are collected as structs, sorted, and adjacent turns of one role merged into one block by array
expressions.  A block is ``<|im_start|>role NEWLINE text <|im_end|> NEWLINE``; the turns merged in it are set
apart by ``<|im_sep|>``.  Inside roles and texts ``%`` becomes ``%25`` and ``<|`` becomes ``<%7C``, so no
text holds a control string and everything can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators.chain import bind, scan

START, END, BETWEEN = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("<%7C"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<%7C"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def merged(turns: Column) -> Column:
    """array<struct<role, text, opens, closes>>: the turns, and whether each is the first or last of its block of one role."""

    def marked(ts: Column) -> Column:
        differs = lambda i: F.coalesce(F.get(ts, i)["role"] != F.get(ts, i + 1)["role"], F.lit(True))
        return F.transform(ts, lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), ((i == 0) | differs(F.greatest(i - 1, F.lit(0)))).alias("opens"), differs(i).alias("closes")))

    return bind(turns, marked)


def before(turn: Column) -> Column:
    """What stands before a turn's text."""
    return F.when(turn["opens"], F.concat(F.lit(START), turn["role"], F.lit("\n"))).otherwise(F.lit(BETWEEN))


def after(turn: Column) -> Column:
    return F.when(turn["closes"], F.lit(END)).otherwise(F.lit(""))


def format_chats(rows: DataFrame, learn_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of begin and length in code points; one for each learned turn).

    Rows are ordered by turn, null turns first, ties by role and text; a null text or role is an empty
    one; repeated rows are turns of their own; rows with a null conversation form one conversation.
    Other columns are not looked at; an empty table gives no rows.  The time is linear in the turns.
    """
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sets = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    marked = sets.select("conv_id", merged(F.transform("ts", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))).alias("ts"))
    sized = lambda t: F.struct(F.char_length(before(t)).cast("long").alias("head"), F.char_length(t["text"]).cast("long").alias("length"), F.char_length(after(t)).cast("long").alias("tail"), (t["role"] == escape_role(F.lit(learn_role))).alias("learned"))

    def spans(sizes: Column) -> Column:
        """A running sum gives the place at which each turn begins."""
        places = scan(sizes, F.lit(0).cast("long"), lambda at, x: at + x["head"] + x["length"] + x["tail"])
        placed = F.zip_with(sizes, F.slice(places, F.lit(1), F.size(sizes)), lambda x, at: F.struct((at + x["head"]).alias("begin"), x["length"].alias("length"), x["learned"].alias("learned")))
        return F.transform(F.filter(placed, lambda x: x["learned"]), lambda x: F.struct(x["begin"].alias("begin"), x["length"].alias("length")))

    formatted = F.array_join(F.transform("ts", lambda t: F.concat(before(t), t["text"], after(t))), "")
    return marked.select("conv_id", formatted.alias("formatted"), bind(F.transform("ts", sized), spans).alias("loss_spans"))


def parse_chats(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"\Q" + START + r"\E", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(END))
        return F.transform(F.split(body, r"\Q" + BETWEEN + r"\E", -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
