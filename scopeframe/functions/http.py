"""Requests and their errors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind
from .responses import text_at

NOT_SUPPORTED, TRANSIENT = "not_supported", "transient"
#: What an error says when the service doesn't know a way of asking. All texts of a line must be there.
COMPLAINTS = (
    ("unsupported parameter",),
    ("unrecognized request argument",),
    ("unknown parameter",),
    ("invalid value: response_format",),
    ("invalid value for response_format",),
    ("response_format", "not supported"),
    ("tool_choice", "not supported"),
    ("tool_choice", "invalid"),
    ("json_schema", "not supported"),
    ("structured outputs", "not supported"),
    ("missing required header", "anthropic-beta"),
    ("unsupported", "response_format"),
    ("unsupported", "tool_choice"),
    ("unsupported", "tool_call"),
    ("unsupported", "json_schema"),
    ("unsupported", "structured outputs"),
)
#: Parameters of a way of asking; an error that names one as its parameter is about it.
PARAMETERS = ("response_format", "tool_choice")


def join_url(base: Column, path: str) -> Column:
    """``path`` after the base without its trailing slashes."""
    return F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit(path))


def error_fields(body: Column) -> Column:
    """message, code and param under ``error``, empty where they aren't strings; null without a JSON ``error``."""
    value = F.try_parse_json(body)
    there = F.try_variant_get(value, "$.error", "variant")
    part = lambda k: F.coalesce(text_at(value, f"$.error.{k}"), F.lit("")).alias(k)
    return F.when(there.isNotNull(), F.struct(part("message"), part("code"), part("param")))


def classify(status: Column, body: Column) -> Column:
    """not_supported: the way of asking is unknown to the service; transient: anything else."""

    def complains(text: Column) -> Column:
        said = F.lit(False)
        for parts in COMPLAINTS:
            here = F.lit(True)
            for x in parts:
                here = here & F.contains(text, F.lit(x))
            said = said | here
        return said

    def about_the_way(fields: Column) -> Column:
        text = F.when(fields.isNotNull(), F.lower(F.concat_ws(" ", fields["message"], fields["code"], fields["param"]))).otherwise(F.lower(body))
        named = F.lower(F.coalesce(fields["param"], F.lit(""))).isin(*PARAMETERS)
        return named | F.coalesce(bind(text, complains), F.lit(False))

    asked = (status >= 400) & (status < 500) & ~status.isin(401, 403, 408, 429)
    return F.when(asked & bind(error_fields(body), about_the_way), NOT_SUPPORTED).otherwise(TRANSIENT)
