from __future__ import annotations

import random
import re

from groundwell.functions.udfs import highlight
from groundwell.plans.text_queries import highlight_segments


def brute(text, quotes):
    """Marks of each character, longest quotes first."""
    own = [None] * len(text)
    for q in sorted(dict.fromkeys(quotes), key=lambda q: -len(q)):
        at = text.find(q)
        while at >= 0:
            if not any(x is not None for x in own[at : at + len(q)]):
                own[at : at + len(q)] = [(q, at)] * len(q)
            at = text.find(q, at + len(q))
    return len({x for x in own if x is not None})


def test_every_sentence_is_marked(spark, tmp_path):
    texts = ["one here. two here. three here. four here. five here", "same one. same one. same one. same one.", "no. or", "line a1\nline a2\nline a3\nline a4\nline a", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["hits"], r["chars"]) for r in highlight_segments(spark, str(tmp_path)).collect()}
    assert got == {i: (brute(t, [x for x in re.split("[.\n] ?", t) if len(x) > 3]), len(t)) for i, t in enumerate(texts)} and got[0][0] == 5


def test_highlight_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("ab ") for _ in range(40))
        quotes = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 4))) for _ in range(6)]
        out = highlight(text, quotes)
        assert sum(x["hit"] for x in out) == brute(text, quotes) and "".join(x["text"] for x in out) == text
