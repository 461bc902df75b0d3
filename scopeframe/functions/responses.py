"""Model responses as column expressions: JSON text in, JSON text out, null where the response is of no use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name of the tool that a model has to call.
TOOL = "submit_identifier"
BOM = "﻿"
SPACE = r"\s\x{85}\p{Z}"


def text_at(value: Column, path: str) -> Column:
    """The string at a path of a VARIANT; null if it is of another type."""
    part = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string"))


def _is_array(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant")).startswith("ARRAY")


def _json(value: Column) -> Column:
    return F.to_json(F.try_parse_json(value))


def _lead(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BOM}*[{SPACE}]*", "")


def content(response: Column) -> Column:
    """The first choice's message as JSON. Fences aren't stripped."""
    return _json(_lead(text_at(F.try_parse_json(response), "$.choices[0].message.content")))


def tool_arguments(response: Column, tool: str = TOOL) -> Column:
    """The arguments, a string of JSON, of the first choice's first tool call, which must be of ``tool``."""
    value = F.try_parse_json(response)
    named = text_at(value, "$.choices[0].message.tool_calls[0].function.name") == tool
    return F.when(named, _json(_lead(text_at(value, "$.choices[0].message.tool_calls[0].function.arguments"))))


def prompt_content(response: Column) -> Column:
    """The first choice's message as JSON. One fence is stripped if the text begins with it."""
    text = F.regexp_replace(text_at(F.try_parse_json(response), "$.choices[0].message.content"), rf"\A{BOM}*[{SPACE}]*|[{SPACE}]*\z", "")
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)\A[^\n]*(\n|\z)", ""), r"(```)+\z", "")
    return _json(F.when(text.startswith("```"), F.regexp_replace(inner, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(text))


def _blocks(response: Column) -> Column:
    value = F.try_parse_json(response)
    return F.when(_is_array(value, "$.content"), F.try_variant_get(value, "$.content", "array<variant>"))


def native_block(response: Column) -> Column:
    """The ``json`` field of the first block of a JSON type."""
    found = F.filter(_blocks(response), lambda b: F.coalesce(text_at(b, "$.type").isin("json", "json_schema", "output_json"), F.lit(False)))
    return F.to_json(F.try_variant_get(F.try_element_at(found, F.lit(1)), "$.json", "variant"))


def tool_input(response: Column, tool: str = TOOL) -> Column:
    """The input, of any type, of the first tool block, which must be of ``tool``."""
    first = F.try_element_at(F.filter(_blocks(response), lambda b: F.coalesce(text_at(b, "$.type") == "tool_use", F.lit(False))), F.lit(1))
    return F.when(text_at(first, "$.name") == tool, F.to_json(F.try_variant_get(first, "$.input", "variant")))


def suggested_name(reply: Column, original: Column) -> Column:
    """The reply's ``name`` if it is a string that isn't blank, trimmed; else the original."""
    name = F.regexp_replace(text_at(F.try_parse_json(reply), "$.name"), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    return F.when(original == "", original).otherwise(F.coalesce(F.nullif(name, F.lit("")), original))
