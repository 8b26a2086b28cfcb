"""Long conversations, null turns, and sums over the elements before."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from groundwell.llm import chat_format
from groundwell.llm.common import sums_before


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_sums_before(spark, chunk):
    rows = [(n, [(i * 7) % 11 for i in range(n)]) for n in (0, 1, 2, 3, 4, 9, 10, 255, 256, 257, 700)]
    df = spark.createDataFrame(rows, "n int, xs array<long>")
    got = {r["n"]: r["s"] for r in df.select("n", sums_before(F.col("xs"), chunk).alias("s")).collect()}
    assert got == {n: [sum(xs[:i]) for i in range(n)] for n, xs in rows}


def test_long_conversations_with_null_turns(spark):
    r = random.Random(0)
    rows = [(c, r.choice((None, i, i)), r.choice(("user", "assistant", "assistant", "system", None, "a|b\n<|")), r.choice(("x", "", None, "é\\<|im_end|>", "long " * 30))) for c, n in ((1, 1), (2, 300), (3, 1200)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat_format.format_conversations(df)
    got = {x["conv_id"]: x for x in out.select("conv_id", "formatted", "loss_spans", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2, 3):
        mine = sorted((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c)
        turns = [(role, text) for _, _, role, text in mine]
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(t for role, t in turns if role == "assistant")
        spans = got[c]["loss_spans"]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)
        marked = [got[c]["formatted"][s["start"] : s["start"] + s["length"]] for s in spans]
        assert [m.replace("<\\|", "<|").replace("\\\\", "\\") for m in marked] == [t for role, t in turns if role == "assistant"]


def test_adjacent_turns_of_a_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")], "conv_id long, turn long, role string, text string")
    want = "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert chat_format.format_conversations(df).first()["formatted"] == want
