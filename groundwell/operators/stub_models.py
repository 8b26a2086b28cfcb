"""Models that need no weights: for runs without a network, and as examples of the protocols."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_LINE = re.compile(r"^- (?:\[(inclusion|exclusion)\] )?(.*)$", re.M)


def quoting_labeller() -> Callable[[str, str], dict]:
    """Finds every inclusion met and every exclusion not met, and quotes the criterion itself."""

    def answer(system: str, user: str) -> dict:
        asked = user.rpartition(" criteria:\n")[2]
        said = [{"criterion": text, "verdict": "not_met" if kind == "exclusion" else "met", "quote": text, "rationale": ""} for kind, text in _LINE.findall(asked)]
        raw = json.dumps({"assessments": said})
        return {"raw": raw, "in_tokens": len(user) // 4, "out_tokens": len(raw) // 4, "provider_usd": None, "served_model": "stub"}

    return answer
