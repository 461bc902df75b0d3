"""One name by a ladder."""

from __future__ import annotations

import sys

from ..functions.texts import SCHEMA, SYSTEM, prompt_text
from .http import Transient
from .ladder import Ladder


def name_for(ladder: Ladder, original: str, surrounding: str) -> tuple[str, str | None, str | None]:
    """The name, the strategy that gave it, and the error because of which the original stayed."""
    if not original:
        return original, None, None
    try:
        reply = ladder.call(SYSTEM, prompt_text(original, surrounding), SCHEMA)
    except Transient as e:
        print(f"scopeframe: no answer for `{original}`: {e}", file=sys.stderr)
        return original, ladder.locked_name, str(e)
    name = reply.get("name") if isinstance(reply, dict) else None
    if not isinstance(name, str) or not name.strip():
        print(f"scopeframe: no valid name in the answer for `{original}`", file=sys.stderr)
        return original, ladder.locked_name, "no valid name in the answer"
    return name.strip(), ladder.locked_name, None
