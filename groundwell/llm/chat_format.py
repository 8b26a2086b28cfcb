r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; all else is done
on that array: a turn looks at its neighbours' roles, and where texts begin
follows from sums over the turns before. A conversation becomes ``<|im_start|>role\n text <|im_end|>\n`` blocks. Turns of
one role in a row share a block, their texts parted by ``<|im_sep|>``, so every
turn can be read back. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\|``; a newline in a role becomes ``<\n>``. After doubling, a run of
one backslash between ``<`` and ``|`` or ``n`` has no other origin, so undoing
the steps in reverse restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import sums_before

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def _bound(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` lists (start, length) in code points, from 0, of each text
    with role ``learn``. Turns go by turn number, ties by role and text, null
    turns first; null roles and texts are empty; a null conversation id is a
    conversation; repeated rows are turns of their own; no rows give no rows.
    One conversation is one output string, so its turns meet in one task.
    """
    turns = df.groupBy(F.col(conv).alias("c")).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("t"))

    def marked(s: Column) -> Column:
        """Each turn with what stands before its text, its escaped text, what stands after, and whether it opens a block."""
        same = lambda i, k: F.get(s, i)["role"].eqNullSafe(F.get(s, i + k)["role"])
        head = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
        return F.transform(
            s,
            lambda x, i: F.struct(
                F.when((i > 0) & same(i, -1), F.lit(SEP)).otherwise(head(x)).alias("lead"),
                escape(x["text"]).alias("body"),
                F.when((i + 1 < F.size(s)) & same(i, 1), F.lit("")).otherwise(F.lit(END)).alias("tail"),
                (x["role"] == learn).alias("learn"),
            ),
        )

    pieces = turns.select("c", _bound(F.col("t"), marked).alias("p"))
    size = lambda x: (F.length(x["lead"]) + F.length(x["body"]) + F.length(x["tail"])).cast("long")
    placed = pieces.select("c", "p", sums_before(F.transform("p", size)).alias("at"))
    span = F.zip_with("p", "at", lambda x, at: F.struct(x["learn"].alias("learn"), (at + F.length(x["lead"])).alias("start"), F.length(x["body"]).cast("long").alias("length")))
    spans = F.transform(F.filter(span, lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"]))
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["lead"], x["body"], x["tail"])), "")
    return placed.select(F.col("c").alias(conv), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of the turns in a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        rest = F.substr(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(END))
        return F.transform(F.split(rest, r"<\|im_sep\|>"), lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
