"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted (turn, then role and text among
ties); runs of adjacent turns of one role are merged with array functions; blocks are
concatenated to

    <|im_start|>role NEWLINE text <|im_sep|> text ... <|im_end|> NEWLINE

Inside texts and roles a backslash is doubled and "<|" becomes "<\\|", so no control string can
stand there and both can be read back; a line end inside a role is written <|nl|>. The loss mask
lists the code-point spans of assistant texts, one for each turn.

Defined results: a null text or role is empty; a null turn sorts first; rows of a null conv_id
form a conversation of their own; repeated rows are turns of their own; an empty table gives an
empty result; further columns are ignored. A conversation is one row, so it must fit into one
(the largest is what a task holds); texts are taken whole, one of two million characters in a test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end, end exclusive) of each conversation of turns (conv_id, turn, role, text)."""
    empty = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def at(i: Column) -> Column:
        return F.element_at("turns", i)

    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i > 1, at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"]).otherwise(True))
    chats = chats.withColumn("starts", starts)

    def run(start: Column, k: Column) -> Column:
        following = F.coalesce(F.try_element_at("starts", k + 2), n + 1)
        texts = F.transform(F.slice("turns", start, following - start), lambda t: escape(t["text"]))
        return F.struct(at(start)["role"].alias("role"), texts.alias("texts"))

    chats = chats.select("conv_id", F.transform("starts", run).alias("runs"))

    def block(r: Column) -> Column:
        return F.concat(F.lit(START), _role(r["role"]), F.lit("\n"), F.array_join(r["texts"], SEP), F.lit(END + "\n"))

    def mask(state: Column, r: Column) -> Column:
        """state: where the run begins, and the spans so far."""
        head = state["at"] + F.length(F.lit(START)) + F.length(_role(r["role"])) + 1
        inner = F.aggregate(
            r["texts"],
            F.struct(head.cast("long").alias("at"), state["spans"].alias("spans")),
            lambda s, text: F.struct(
                (s["at"] + F.length(text) + len(SEP)).cast("long").alias("at"),
                F.when(r["role"] == loss_role, F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(text)).cast("long").alias("end"))))).otherwise(s["spans"]).alias("spans"),
            ),
        )
        return F.struct((inner["at"] - len(SEP) + len(END) + 1).cast("long").alias("at"), inner["spans"].alias("spans"))

    zero = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, end: bigint>>))")
    return chats.select("conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"), F.aggregate("runs", zero, mask)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text) and loss_text, both read from the formatted text and the mask only."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        role = unescape(F.replace(F.regexp_extract(b, r"^<\|im_start\|>([^\n]*)\n", 1), F.lit(NEWLINE), F.lit("\n")))
        body = F.regexp_replace(b, r"^[^\n]*\n", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns_of)), "loss_text": F.array_join(loss, "")})


def digests(formatted: DataFrame) -> DataFrame:
    """What reading back gives, by conversation."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
