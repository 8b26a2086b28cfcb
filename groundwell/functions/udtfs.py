"""Table functions for SQL: ``criteria(raw)`` and ``websearch_terms(q)``.

    register(spark)
    SELECT t.nct_id, c.* FROM trials t, LATERAL criteria(t.eligibility_raw) c
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Marks that go from a text, with what stays of each.
_MARKS = [(re.compile(p), r"\1" if "(" in p.replace(r"\(", "") else "") for p in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"#{1,6}\s*", r"\[(.+?)\]\(.+?\)", r"`(.+?)`")]
_HEADS = {k: re.compile(rf"{k} criteria[:\s]*", re.I) for k in ("inclusion", "exclusion")}
_BULLET = re.compile(r"\A[\d.\-*•]+\s*")
#: A criterion has more characters than this.
SHORT = 10


def criteria_of(raw: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the criteria of a raw text, inclusions first; a text without headings holds inclusions."""
    text = raw or ""
    for pattern, stays in _MARKS:
        text = pattern.sub(stays, text)
    text = text.strip()
    found = sorted((m.start(), m.end(), kind) for kind, p in _HEADS.items() if (m := p.search(text)))
    ends = [start for start, _, _ in found[1:]] + [len(text)]
    parts = {kind: text[begin:end] for (_, begin, kind), end in zip(found, ends)} or {"inclusion": text}
    lines = {kind: [x for line in part.splitlines() if len(x := _BULLET.sub("", line.strip()).strip()) > SHORT] for kind, part in parts.items()}
    return [(kind, x) for kind in _HEADS for x in lines.get(kind, ())]


@udtf(returnType="pos int, kind string, text string")
class Criteria:
    def eval(self, raw: str) -> Iterator[tuple]:
        for pos, (kind, text) in enumerate(criteria_of(raw)):
            yield pos, kind, text


@udtf(returnType="alternative int, part int, negated boolean, word int, term string")
class WebsearchTerms:
    """A row for each word of a web-style query: its alternative, its phrase within it, and its place in that."""

    def eval(self, q: str) -> Iterator[tuple]:
        from groundwell.operators.lexical import parse_websearch

        for i, group in enumerate(parse_websearch(q or "")):
            for j, (negated, words) in enumerate(group):
                for k, word in enumerate(words):
                    yield i, j, negated, k, word


def register(spark: SparkSession) -> None:
    spark.udtf.register("criteria", Criteria)
    spark.udtf.register("websearch_terms", WebsearchTerms)
