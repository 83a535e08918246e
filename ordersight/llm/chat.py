"""Relational chat formatting: conversations as one marked-up string each.

Column expressions only. The turns of a conversation are collected as structs
and sorted by turn; adjacent turns of one role are merged into one block by
array expressions, and the pieces are concatenated. The template is::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

so merged turns stay apart and every turn can be read back. Control strings
inside texts and roles cannot be taken for marks: each ``<`` with any number of
backslashes and a ``|`` after it gets one more backslash, which ``parse`` takes
off again; a line feed in a role is written as ``%0A`` (and ``%`` as ``%25``).

The loss mask is an array of ``(start, end)`` spans in code points, one for
each text of a trained role, without marks.

A conversation is one output row, so its turns have to meet in one task. Its
array steps are linear in their number; the places of the spans are running sums
inside blocks of turns, and over the blocks.

Defined cases: a null text or role is an empty one. A null turn sorts first;
ties are sorted by role, then text, so repeated rows are repeated turns. A null
conversation id is a conversation of its own. An empty table gives no rows.
Columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK, _CUT = 256, 2048
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _sums_by_block(sizes: Column) -> Column:
    """Running sums inside each block of ``_BLOCK`` numbers."""
    block = lambda k: F.slice(sizes, k * _BLOCK + 1, F.lit(_BLOCK))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda k: F.aggregate(
        block(k), F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))


def _running(sums: Column) -> Column:
    """Running sums over all blocks: those inside a block, and the total of the blocks before it."""
    last = lambda a: F.element_at(a, -1)
    before = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.array_append(a, last(a) + last(s)))
    return F.flatten(F.zip_with(sums, F.slice(before, F.lit(1), F.size(sums)), lambda s, b: F.transform(s, lambda x: x + b)))


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans array<struct<start,end>>``, one row per conversation."""
    c = lambda name: F.col(f"`{name}`")
    one = turns.select(c(id_col).cast("long").alias("conv_id"), F.struct(
        c(turn_col).cast("long").alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    rows = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    # Blocks: the places where the role changes, and for each the texts up to the next place.
    n = F.size("t")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    rows = rows.withColumn("heads", heads)
    blocks = F.transform("heads", lambda i, k: F.struct(
        F.get("t", i)["role"].alias("role"),
        F.transform(F.slice("t", i + 1, F.coalesce(F.get("heads", k + 1), n) - i),
                    lambda t: escape(t["text"])).alias("texts")))
    rows = rows.withColumn("blocks", blocks)

    # Pieces of text, each with the mark before it; the mark after the last is END.
    pieces = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda x, j: F.struct(
        F.when(j > 0, F.lit(SEP)).otherwise(F.concat(
            F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), _role_out(b["role"]), F.lit("\n"))).alias("mark"),
        x.alias("text"), b["role"].isin(*train_roles).alias("train")))))
    rows = rows.withColumn("pieces", pieces)
    rows = rows.withColumn("sizes", F.transform("pieces", lambda p: F.length(p["mark"]) + F.length(p["text"])))
    rows = rows.withColumn("sums", _sums_by_block(F.col("sizes")))
    at = F.zip_with("pieces", _running(F.col("sums")), lambda p, e: F.struct(
        (e - F.length(p["text"])).alias("start"), e.alias("end"), p["train"].alias("train")))
    spans = F.transform(F.filter(at, lambda x: x["train"]), lambda x: F.struct(x["start"], x["end"]))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END))
    return rows.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: ``array<struct<role,text>>``."""
    blocks = F.array_remove(F.split(formatted, r"<\|im_end\|>\n"), "")
    head = F.length(F.lit(START))
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring(b, F.locate("\n", b) + 1, F.length(b)), r"<\|im_sep\|>"),
        lambda x: F.struct(_role_in(F.substring(b, head + 1, F.locate("\n", b) - 1 - head)).alias("role"),
                           unescape(x).alias("text")))))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped, one after the other.

    A place in a string is found by counting from its start, so the string is first cut into blocks.
    """
    def text(blocks: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / _CUT), F.floor((s["end"] - 1) / _CUT)
        near = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.greatest(last, first) - first + 1).cast("int")), "")
        return unescape(F.substring(near, (s["start"] - first * _CUT + 1).cast("int"), s["end"] - s["start"]))

    cut = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    # a variable of the outer function, so that the blocks are made once
    return F.transform(F.array(cut), lambda b: F.array_join(F.transform(spans, lambda s: text(b, s)), ""))[0]
