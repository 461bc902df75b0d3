"""POST of JSON by the standard library, and the classes of its errors."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any

from ..functions.http import COMPLAINTS, PARAMETERS

#: Seconds, where no preset says otherwise.
DEFAULT_TIMEOUT = 600


class NotSupported(Exception):
    """The service doesn't know this way of asking."""


class Transient(Exception):
    """Anything else; another call may go well."""


def fields_of(body: str) -> tuple[str, str, str] | None:
    """message, code and param under ``error``; None without a JSON ``error``."""
    try:
        value = json.loads(body)
    except ValueError:
        return None
    error = value.get("error") if isinstance(value, dict) else None
    if error is None and not (isinstance(value, dict) and "error" in value):
        return None
    pick = lambda k: error.get(k) if isinstance(error, dict) and isinstance(error.get(k), str) else ""
    return pick("message"), pick("code"), pick("param")


def error_for(status: int, body: str) -> NotSupported | Transient:
    if status == 429:
        return Transient("http 429: rate limited")
    if status == 408:
        return Transient("http 408: request timeout")
    if 400 <= status < 500 and status not in (401, 403):
        fields = fields_of(body)
        text = (" ".join(fields) if fields is not None else body).lower()
        named = fields is not None and fields[2].lower() in PARAMETERS
        if named or any(all(x in text for x in parts) for parts in COMPLAINTS):
            return NotSupported(f"http {status}: {fields[0] if fields else body}")
    return Transient(f"http {status}: {body}")


class HttpClient:
    def __init__(self, timeout: float = DEFAULT_TIMEOUT):
        self.timeout = timeout

    def post_json(self, url: str, key: str | None, headers: dict[str, str], body: Any) -> Any:
        """The reply's JSON; raises NotSupported or Transient."""
        sent = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}) | headers
        request = urllib.request.Request(url, json.dumps(body).encode(), sent, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                text = reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise error_for(e.code, e.read().decode("utf-8", "replace")) from None
        except (OSError, ValueError) as e:
            raise Transient(f"request failed: {e}") from None
        try:
            return json.loads(text)
        except ValueError as e:
            raise Transient(f"the reply isn't JSON: {e}") from None
