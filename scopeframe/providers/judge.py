"""A model's verdict on how readable code is, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable

from .http import Transient
from .strategies import Strategy

VERDICTS = ("EXCELLENT", "GOOD", "GIBBERISH", "MINIFIED")
WAITS = (5, 15, 30, 60)
SYSTEM = "You judge the names in JavaScript code. EXCELLENT: all say what things are; GOOD: most do; GIBBERISH: words without sense; MINIFIED: a letter or two each. Answer as JSON."
SCHEMA = {"type": "object", "additionalProperties": False, "required": ["verdict"], "properties": {"verdict": {"type": "string", "enum": list(VERDICTS)}}}


def judge(strategy: Strategy, code: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """The verdict. A transient error is tried again, four times in all, with a wait after each."""
    last: Exception | None = None
    for wait in WAITS:
        try:
            reply = strategy.call(SYSTEM, f"```javascript\n{code}\n```", SCHEMA)
            verdict = reply.get("verdict") if isinstance(reply, dict) else None
            if verdict in VERDICTS:
                return verdict
            raise ValueError(f"no verdict: {reply!r}")
        except Transient as e:
            last = e
            sleep(wait)
    raise last
