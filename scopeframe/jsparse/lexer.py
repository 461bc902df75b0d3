"""Tokens of JavaScript (modules, ES2024). The parser says where a regular expression may begin."""

from __future__ import annotations

import re
from typing import NamedTuple

NAME, PUNCT, NUMBER, STRING, TEMPLATE, REGEX, PRIVATE, EOF = "name", "punct", "number", "string", "template", "regex", "private", "eof"


class ParseError(ValueError):
    """The source is not a module that can be parsed."""


class Token(NamedTuple):
    kind: str
    value: str
    start: int
    end: int
    line_before: bool


_SPACE = re.compile(r"(?:[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+|(?P<nl>[\n\r\u2028\u2029]+)|//[^\n\r\u2028\u2029]*|(?P<c>/\*.*?\*/))", re.S)
_ID_START = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_ID_PART = r"(?:\w|[$\u200c\u200d\u00b7]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_NAME = re.compile(_ID_START + _ID_PART + "*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|.))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{)", re.S)
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_ESCAPE = re.compile(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))")


class Lexer:
    def __init__(self, source: str):
        self.source, self.at = source, 0
        if source.startswith("#!"):
            self.at = len(source.split("\n", 1)[0])

    def error(self, what: str, at: int) -> ParseError:
        line = self.source.count("\n", 0, at) + 1
        return ParseError(f"{what} (line {line})")

    def next(self, regex: bool) -> Token:
        """The next token; ``regex``: a slash begins a regular expression."""
        source, at, line = self.source, self.at, False
        while m := _SPACE.match(source, at):
            at = m.end()
            line = line or m["nl"] is not None or bool(m["c"] and re.search(r"[\n\r\u2028\u2029]", m["c"]))
        if at >= len(source):
            self.at = at
            return Token(EOF, "", at, at, line)
        c = source[at]
        if m := _NAME.match(source, at):
            value = m[0]
            if "\\" in value:
                value = _ESCAPE.sub(lambda x: chr(int(x[1] or x[2], 16)), value)
            kind = NAME
        elif c == "#" and (m := _NAME.match(source, at + 1)):
            kind, value = PRIVATE, "#" + m[0]
        elif (c.isdigit() or c == "." and source[at + 1 : at + 2].isdigit()) and (m := _NUMBER.match(source, at)):
            kind, value = NUMBER, m[0]
            if _NAME.match(source, m.end()):
                raise self.error("Invalid number", at)
        elif c in "'\"":
            m = _STRING.match(source, at)
            if not m:
                raise self.error("Unterminated string", at)
            kind, value = STRING, m[0]
        elif c == "`":
            kind, value, m = TEMPLATE, "`", re.compile("`").match(source, at)
        elif c == "/" and source.startswith("/*", at):
            raise self.error("Unterminated comment", at)
        elif c == "/" and regex:
            m = _REGEX.match(source, at)
            if not m:
                raise self.error("Invalid regular expression", at)
            kind, value = REGEX, m[0]
        elif m := _PUNCT.match(source, at):
            kind, value = PUNCT, m[0]
        else:
            raise self.error(f"Unexpected character {c!r}", at)
        self.at = m.end()
        return Token(kind, value, at, m.end(), line)

    def template_part(self) -> bool:
        """Skip a template's characters from here; whether an expression follows."""
        m = _TEMPLATE.match(self.source, self.at)
        if not m:
            raise self.error("Unterminated template", self.at)
        self.at = m.end()
        return m["end"] != "`"
