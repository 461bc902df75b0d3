"""Presets, settings and their order of precedence."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from .http import HttpClient
from .ladder import Ladder
from .strategies import ForcedTool, JsonSchema, MessagesNative, MessagesTool, NudgedTool, PromptedJson

CHAT, MESSAGES = "openai_compat", "anthropic"
CONTEXT_SIZE = 500


@dataclass(frozen=True)
class Preset:
    name: str
    base_url: str
    model: str
    key_variable: str
    kind: str
    timeout: int


#: The services' addresses, models, key variables and timeouts.
PRESETS = {
    p.name: p
    for p in (
        Preset("openai", "https://api.openai.com/v1", "gpt-5-mini", "OPENAI_API_KEY", CHAT, 60),
        Preset("gemini", "https://generativelanguage.googleapis.com/v1beta/openai/", "gemini-3.1-flash-lite", "GEMINI_API_KEY", CHAT, 60),
        Preset("anthropic", "https://api.anthropic.com/v1", "claude-sonnet-4-6", "ANTHROPIC_API_KEY", MESSAGES, 60),
        Preset("ollama", "http://localhost:11434/v1", "qwen3.5:4b", "", CHAT, 1800),
        Preset("openrouter", "https://openrouter.ai/api/v1", "openai/gpt-oss-120b", "OPENROUTER_API_KEY", CHAT, 60),
        Preset("requesty", "https://router.requesty.ai/v1", "nvidia/nemotron-3-super-120b-a12b", "REQUESTY_API_KEY", CHAT, 60),
    )
}


def replace_variable(preset: Preset, variable: str) -> Preset:
    """The preset with another environment variable for the key; empty: none."""
    return replace(preset, key_variable=variable)


class JsonMode(Enum):
    LADDER = "ladder"
    JSON_SCHEMA = "openai-json-schema"
    NATIVE = "anthropic-native"
    FORCED_TOOL = "forced-tool-call"
    NUDGED_TOOL = "tool-call-and-prompt"
    PROMPT = "prompt"

    @classmethod
    def parse(cls, text: str) -> JsonMode:
        for x in cls:
            if x.value == text:
                return x
        raise ValueError(f"{text!r} is no JSON mode; there are {', '.join(x.value for x in cls)}")


STRATEGY_OF = {JsonMode.JSON_SCHEMA: JsonSchema, JsonMode.NATIVE: MessagesNative, JsonMode.FORCED_TOOL: ForcedTool, JsonMode.NUDGED_TOOL: NudgedTool, JsonMode.PROMPT: PromptedJson}
DEFAULT_LADDER = {CHAT: (JsonSchema, ForcedTool, PromptedJson), MESSAGES: (MessagesTool,)}


def mode_error(mode: JsonMode, kind: str) -> str | None:
    """Why a mode doesn't go with a kind of service; None if it does."""
    if mode is JsonMode.NATIVE and kind == CHAT:
        return f"JSON mode {mode.value} needs the Messages API (preset anthropic)"
    if mode not in (JsonMode.NATIVE, JsonMode.LADDER) and kind == MESSAGES:
        return f"JSON mode {mode.value} isn't for the Messages API; it takes {JsonMode.NATIVE.value} or {JsonMode.LADDER.value}"
    return None


def key_from(variable: str) -> str | None:
    """An empty variable counts as unset."""
    return os.environ.get(variable) or None if variable else None


@dataclass
class Settings:
    """What holds after the command line, then (for the key) the environment, then the preset. ``given``: what the command
    line had."""

    preset: Preset
    base_url: str
    model: str
    key: str | None
    mode: JsonMode
    context_size: int
    timeout: int
    given: frozenset[str]

    @classmethod
    def of(cls, preset: Preset, **given) -> Settings:
        given = {k: v for k, v in given.items() if v is not None}
        mode = JsonMode.parse(given.get("json_mode", "ladder"))
        if error := mode_error(mode, preset.kind):
            raise ValueError(error)
        return cls(
            preset,
            given.get("base_url", preset.base_url),
            given.get("model", preset.model),
            given.get("api_key") if "api_key" in given else key_from(preset.key_variable),
            mode,
            given.get("context_size", CONTEXT_SIZE),
            given.get("timeout_seconds", preset.timeout),
            frozenset(given),
        )

    def ladder(self) -> Ladder:
        client = HttpClient(self.timeout)
        kinds = DEFAULT_LADDER[self.preset.kind] if self.mode is JsonMode.LADDER else (STRATEGY_OF[self.mode],)
        return Ladder([k(client, self.base_url, self.key, self.model) for k in kinds], self.mode is not JsonMode.LADDER)

    def report(self, source: str, output: str | None) -> list[str]:
        """Lines that say each setting and where it is from; the key itself is never shown."""
        by = lambda k: "command line" if k in self.given else "default"
        key = "not set" if self.key is None else f"set ({'command line' if 'api_key' in self.given else self.preset.key_variable})"
        return [
            f"* provider: {self.preset.name}",
            f"* model: {self.model} ({by('model')})",
            f"* base URL: {self.base_url} ({by('base_url')})",
            f"* API key: {key}",
            f"* JSON mode: {self.mode.value} ({by('json_mode')})",
            f"* context size: {self.context_size} ({by('context_size')})",
            f"* timeout: {self.timeout}s ({by('timeout_seconds')})",
            f"* input: {source}",
            f"* output: {output or 'stdout'}",
        ]


def presets_table(spark: SparkSession) -> DataFrame:
    rows = [(p.name, p.base_url, p.model, p.key_variable or None, p.kind, p.timeout, [k.name for k in DEFAULT_LADDER[p.kind]]) for p in PRESETS.values()]
    return spark.createDataFrame(rows, "name string, base_url string, model string, key_variable string, kind string, timeout_seconds long, ladder array<string>")
