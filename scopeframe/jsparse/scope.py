"""Scopes, symbols and references of a module, with UTF-8 byte offsets."""

from __future__ import annotations

import sys
from bisect import bisect_right
from dataclasses import dataclass, field

from .lexer import ParseError
from .parser import Parser


@dataclass
class Scope:
    id: int
    parent: int | None
    kind: str
    start: int
    end: int
    exit: int = 0
    names: dict[str, int] = field(default_factory=dict)
    passed: set[str] = field(default_factory=set)  # of ``var``s that are declared inside and belong further out


#: Kinds that may be declared once in a scope, and beside nothing else.
ONCE = frozenset(("let", "const", "class", "import", "using"))


@dataclass
class Analysis:
    """scopes: (id, parent, kind, start, end, enter, exit); symbols: (id, name, scope, start, end, kind); references: (name,
    symbol or None, scope, start, end, form). A scope d is strictly below a if enter[a] < enter[d] < exit[a]. ``form`` tells
    how a name is rewritten: plain, short (``{a}``), import or export. Declarations are references too, with kind in symbols
    for the first one."""

    scopes: list[tuple]
    symbols: list[tuple]
    references: list[tuple]


class _Walk:
    def __init__(self, length: int):
        self.scopes = [Scope(0, None, "program", 0, length)]
        self.symbols: list[tuple] = []
        self.found: list[tuple] = []  # name, symbol or None, scope, start, end, form

    def open(self, kind: str, start: int, end: int, parent: int) -> int:
        self.scopes.append(Scope(len(self.scopes), parent, kind, start, end))
        return len(self.scopes) - 1

    def declare(self, node: tuple, scope: int, kind: str) -> None:
        _, name, start, end, form = node
        names = self.scopes[scope].names
        symbol = names.get(name)
        self.check(name, kind, scope, None if symbol is None else self.symbols[symbol][5])
        if symbol is None:
            symbol = names[name] = len(self.symbols)
            self.symbols.append((symbol, name, scope, start, end, kind))
        self.found.append((name, symbol, scope, start, end, form or "plain"))

    def check(self, name: str, kind: str, scope: int, before: str | None) -> None:
        """Raise ParseError for a name that its scope, or one that a ``var`` passes, has already."""
        here = self.scopes[scope]
        clash = before is not None and (kind in ONCE or before in ONCE or kind == before and kind in ("parameter", "catch"))
        if kind in ONCE:
            clash = clash or name in here.passed
            if here.kind == "block" and here.parent is not None and self.scopes[here.parent].kind == "catch":
                clash = clash or name in self.scopes[here.parent].names
        if clash:
            raise ParseError(f"{name} is declared already")

    def pass_out(self, node: tuple, scope: int, target: int) -> None:
        """Note the names of a ``var`` pattern in the scopes between the statement and the scope they belong to."""
        what = node[0]
        if what == "id":
            while scope != target:
                here = self.scopes[scope]
                at = here.names.get(node[1])
                if at is not None and self.symbols[at][5] in ONCE:
                    raise ParseError(f"{node[1]} is declared already")
                here.passed.add(node[1])
                scope = here.parent
        elif what in ("object", "array"):
            for x in node[1]:
                self.pass_out(x[1] if what == "object" else x, scope, target)
        elif what in ("spread", "assign"):
            self.pass_out(node[1], scope, target)

    def hoisted(self, scope: int) -> int:
        while self.scopes[scope].kind not in ("program", "function", "arrow", "static"):
            scope = self.scopes[scope].parent
        return scope

    def bind(self, node: tuple, target: int, scope: int, kind: str) -> None:
        """Declare the names of a pattern in ``target``; its expressions are in ``scope``."""
        what = node[0]
        if what == "id":
            self.declare(node, target, kind)
        elif what == "object":
            for key, value in node[1]:
                if key is not None:
                    self.visit(key, scope)
                self.bind(value, target, scope, kind)
        elif what == "array":
            for x in node[1]:
                self.bind(x, target, scope, kind)
        elif what == "spread":
            self.bind(node[1], target, scope, kind)
        elif what == "assign":
            self.bind(node[1], target, scope, kind)
            self.visit(node[2], scope)

    def visit(self, node: tuple, scope: int) -> None:
        what = node[0]
        if what == "id":
            self.found.append((node[1], None, scope, node[2], node[3], node[4] or "plain"))
        elif what in ("many", "array", "target"):
            for x in node[1]:
                self.visit(x, scope)
        elif what == "object":
            for key, value in node[1]:
                if key is not None:
                    self.visit(key, scope)
                self.visit(value, scope)
        elif what == "assign":
            self.visit(node[1], scope)
            self.visit(node[2], scope)
        elif what in ("spread", "paren"):
            self.visit(node[1], scope)
        elif what == "variables":
            kind = node[1]
            target = self.hoisted(scope) if kind == "var" else scope
            for pattern, value in node[2]:
                self.pass_out(pattern, scope, target)
                self.bind(pattern, target, scope, kind)
                if value is not None:
                    self.visit(value, scope)
        elif what == "block":
            inner = self.open("block", node[1], node[2], scope)
            for x in node[3]:
                self.visit(x, inner)
        elif what == "scope":
            inner = self.open(node[1], node[2], node[3], scope)
            for x in node[4]:
                self.visit(x, inner)
        elif what == "catch":
            _, start, end, pattern, body = node
            inner = self.open("catch", start, end, scope)
            if pattern is not None:
                self.bind(pattern, inner, inner, "catch")
            self.visit(body, inner)
        elif what == "function":
            _, kind, start, end, name, params, body = node
            if name is not None and kind == "declaration":
                self.declare(name, scope, "function")
            elif name is not None:
                scope = self.open("name", start, end, scope)
                self.declare(name, scope, "function")
            inner = self.open("arrow" if kind == "arrow" else "function", start, end, scope)
            for x in params:
                self.bind(x, inner, inner, "parameter")
            for x in body:
                self.visit(x, inner)
        elif what == "class":
            _, declared, start, end, name, heritage, members = node
            if name is not None and declared:
                self.declare(name, scope, "class")
            inner = self.open("class", start, end, scope)
            if name is not None and not declared:
                self.declare(name, inner, "class")
            if heritage is not None:
                self.visit(heritage, inner)
            for x in members:
                self.visit(x, inner)
        else:
            raise ParseError("Unexpected parameters")

    def resolve(self) -> None:
        for s in reversed(self.scopes):
            s.exit = max(s.exit, s.id + 1)
            if s.parent is not None:
                self.scopes[s.parent].exit = max(self.scopes[s.parent].exit, s.exit)
        for i, (name, symbol, scope, *rest) in enumerate(self.found):
            at: int | None = scope
            while symbol is None and at is not None:
                symbol = self.scopes[at].names.get(name)
                at = self.scopes[at].parent
            self.found[i] = (name, symbol, scope, *rest)


def analyse(source: str) -> Analysis:
    """Scopes are numbered in preorder, so a scope's number is its enter index. Raises ParseError."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    try:
        walk = _Walk(len(source))
        for x in Parser(source).program():
            walk.visit(x, 0)
    except RecursionError:
        raise ParseError("Nesting is too deep") from None
    walk.resolve()
    if source.isascii():
        at = lambda i: i
    else:
        wide = [i for i, c in enumerate(source) if c > "\x7f"]
        sums = [0]
        for i in wide:
            sums.append(sums[-1] + len(source[i].encode("utf-8", "surrogatepass")) - 1)
        at = lambda i: i + sums[bisect_right(wide, i - 1)]
    return Analysis(
        [(s.id, s.parent, s.kind, at(s.start), at(s.end), s.id, s.exit) for s in walk.scopes],
        [(i, name, scope, at(a), at(b), kind) for i, name, scope, a, b, kind in walk.symbols],
        [(name, symbol, scope, at(a), at(b), form) for name, symbol, scope, a, b, form in sorted(walk.found, key=lambda x: x[3])],
    )
