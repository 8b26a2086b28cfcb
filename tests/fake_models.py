"""Small stand-ins for encoders, rerankers and labellers."""

from __future__ import annotations

import json
import re


def encoder():
    """Counts of the letters a to d."""
    return lambda texts, is_query: [[float(t.count(c)) for c in "abcd"] for t in texts]


def scorer():
    """How many words of the note the text holds."""
    return lambda pairs: [len({*n.split()} & {*t.split()}) for n, t in pairs]


def labeller():
    """Answers ``met`` with the criterion as quote; one that says ``wrong`` misquotes until it is told again, ``never`` always."""

    def answer(system: str, user: str) -> dict:
        if "explode" in user:
            raise RuntimeError("model fell over")
        again = "[Retry" in user
        found = re.findall(r"^- \[(inclusion|exclusion)\] (.*)$", user, re.M)
        said = []
        for kind, text in found:
            bad = "never" in text or ("wrong" in text and not again)
            said.append({"criterion": text, "verdict": "met" if kind == "inclusion" else "not_met", "quote": "not in there" if bad else text, "rationale": ""})
        raw = "```json\n" + json.dumps({"assessments": said}) + "\n```"
        return {"raw": raw, "in_tokens": len(user) // 4, "out_tokens": len(raw) // 4, "provider_usd": None, "served_model": "fake-1"}

    return answer


def keyworder():
    """The words of the note as keywords."""

    def answer(system: str, user: str) -> dict:
        if "explode" in user:
            raise RuntimeError("model fell over")
        return {"raw": json.dumps({"keywords": user.split()}), "in_tokens": 1, "out_tokens": 1}

    return answer
