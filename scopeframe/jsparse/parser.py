"""Recursive descent over JavaScript modules, to a small tree that holds what scope analysis needs.

Nodes are tuples. Expressions: ("id", name, start, end, short), ("many", [nodes]), ("assign", target, value),
("object", [(computed key or None, value)]), ("array", [nodes]), ("spread", node), ("paren", node), ("function", ...),
("class", ...). Operators and literals leave nothing behind.
"""

from __future__ import annotations

from .lexer import EOF, NAME, NUMBER, PRIVATE, PUNCT, REGEX, STRING, TEMPLATE, Lexer, ParseError, Token

#: Words that can't be bindings, from ECMA-262 (reserved words, and those reserved in strict code).
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function "
    "if import in instanceof new null return super switch this throw true try typeof var void while with yield "
    "implements interface let package private protected public static".split()
)
#: Those that can't be an identifier expression even in sloppy code.
HARD = RESERVED - frozenset("await yield implements interface let package private protected public static".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
NOTHING = ("many", [])


class Parser:
    def __init__(self, source: str):
        self.lexer = Lexer(source)
        self.source = source
        self.last_end = 0
        self.in_async, self.in_generator, self.depth = True, False, 0
        self.half: set[int] = set()  # starts of `a = 1` in object literals, which only patterns may hold
        self.token = self.lexer.next(True)

    # tokens

    def fail(self, token: Token | None = None) -> ParseError:
        token = token or self.token
        return self.lexer.error("Unexpected end" if token.kind == EOF else f"Unexpected token {token.value!r}", token.start)

    def step(self, regex: bool = False) -> Token:
        """Go on; ``regex``: what comes next may be an expression."""
        token = self.token
        self.last_end = token.end
        self.token = self.lexer.next(regex)
        return token

    def rescan(self) -> None:
        """The current token begins an expression: a slash is a regular expression."""
        if self.token.kind == PUNCT and self.token.value in ("/", "/="):
            line = self.token.line_before
            self.lexer.at = self.token.start
            self.token = self.lexer.next(True)._replace(line_before=line)

    def at(self, *values: str) -> bool:
        return self.token.kind == PUNCT and self.token.value in values

    def word(self, *values: str) -> bool:
        return self.token.kind == NAME and self.token.value in values and self.token.end - self.token.start == len(self.token.value)

    def accept(self, value: str) -> bool:
        if self.at(value):
            self.step()
            return True
        return False

    def expect(self, value: str) -> Token:
        if not self.at(value):
            raise self.fail()
        return self.step()

    def expect_word(self, value: str) -> Token:
        if not self.word(value):
            raise self.fail()
        return self.step()

    def peek(self) -> Token:
        at, token = self.lexer.at, self.lexer.next(False)
        self.lexer.at = at
        return token

    def end_statement(self) -> None:
        if self.accept(";") or self.at("}") or self.token.kind == EOF or self.token.line_before:
            return
        raise self.fail()

    # program and statements

    def program(self) -> list:
        body = []
        while self.token.kind != EOF:
            body.append(self.statement(True))
        if self.half:
            raise self.lexer.error("Invalid shorthand property initializer", min(self.half))
        return body

    def block(self) -> tuple:
        start = self.expect("{").start
        body = self.statements()
        return ("block", start, self.last_end, body)

    def statements(self) -> list:
        body = []
        while not self.at("}"):
            if self.token.kind == EOF:
                raise self.fail()
            body.append(self.statement(True))
        self.step()
        return body

    def statement(self, declarations: bool = False) -> tuple:
        token = self.token
        if token.kind == PUNCT:
            if token.value == "{":
                return self.block()
            if token.value == ";":
                self.step()
                return NOTHING
            if token.value == "@":
                decorators = self.decorators()
                if self.word("export"):
                    return ("many", [decorators, self.export()])
                return ("many", [decorators, self.class_(True)])
        elif token.kind == NAME and token.end - token.start == len(token.value):
            special = getattr(self, f"on_{token.value}", None) if token.value in STATEMENTS else None
            if special:
                return special()
            after = self.peek() if token.value in ("let", "async", "import") or token.value not in RESERVED else None
            if token.value == "let" and (after.kind == NAME and after.value not in ("in", "instanceof", "of") or after.kind == PUNCT and after.value in "[{"):
                return self.variables_statement()
            if token.value == "async" and after.kind == NAME and after.value == "function" and not after.line_before:
                return self.function(True)
            if token.value == "import" and not (after.kind == PUNCT and after.value in "(."):
                return self.import_()
            if after is not None and after.kind == PUNCT and after.value == ":" and token.value not in RESERVED | {"async"}:
                self.step()
                self.step(True)
                return self.statement()
        expression = self.expression()
        self.end_statement()
        return expression

    def on_var(self) -> tuple:
        return self.variables_statement()

    on_const = on_var

    def variables_statement(self) -> tuple:
        out = self.variables(True)
        self.end_statement()
        return out

    def variables(self, with_in: bool) -> tuple:
        kind, parts = self.step().value, []
        while True:
            target = self.pattern()
            value = None
            if self.accept("="):
                value = self.assignment(with_in)
            parts.append((target, value))
            if not self.accept(","):
                return ("variables", kind, parts)

    def on_function(self) -> tuple:
        return self.function(True)

    def on_class(self) -> tuple:
        return self.class_(True)

    def on_if(self) -> tuple:
        parts = []
        while True:  # a chain of else-ifs is no recursion
            self.step()
            parts += [self.condition(), self.statement()]
            if not self.word("else"):
                return ("many", parts)
            self.step(True)
            if not self.word("if"):
                return ("many", [*parts, self.statement()])

    def condition(self) -> tuple:
        self.expect("(")
        out = self.expression()
        self.expect(")")
        self.rescan()
        return out

    def on_while(self) -> tuple:
        self.step()
        return ("many", [self.condition(), self.statement()])

    on_with = on_while

    def on_do(self) -> tuple:
        self.step(True)
        body = self.statement()
        self.expect_word("while")
        test = self.condition()
        self.accept(";")
        return ("many", [body, test])

    def on_for(self) -> tuple:
        start = self.step().start
        if self.word("await"):
            self.step()
        self.expect("(")
        self.rescan()
        parts = []
        if self.at(";"):
            pass
        elif self.word("var", "const") or self.word("let") and ((a := self.peek()).kind == NAME and a.value not in ("in", "of") or a.kind == PUNCT and a.value in "[{"):
            parts.append(self.variables(False))
        else:
            parts.append(self.expression(False))
        if self.word("of"):
            self.settle(parts[0])
            self.step(True)
            parts.append(self.assignment())
        elif self.word("in"):
            self.settle(parts[0])
            self.step(True)
            parts.append(self.expression())
        else:
            self.expect(";")
            self.rescan()
            if not self.at(";"):
                parts.append(self.expression())
            self.expect(";")
            self.rescan()
            if not self.at(")"):
                parts.append(self.expression())
        self.expect(")")
        self.rescan()
        parts.append(self.statement())
        return ("scope", "for", start, self.last_end, parts)

    def on_switch(self) -> tuple:
        start = self.step().start
        parts, cases = [self.condition()], []
        self.expect("{")
        while not self.accept("}"):
            if self.word("case"):
                self.step(True)
                cases.append(self.expression())
            else:
                self.expect_word("default")
            self.expect(":")
            self.rescan()
            while not (self.word("case", "default") or self.at("}")):
                if self.token.kind == EOF:
                    raise self.fail()
                cases.append(self.statement(True))
        return ("many", [*parts, ("scope", "switch", start, self.last_end, cases)])

    def on_try(self) -> tuple:
        self.step()
        parts = [self.block()]
        if self.word("catch"):
            start = self.step().start
            target = None
            if self.accept("("):
                target = self.pattern()
                self.expect(")")
            body = self.block()
            parts.append(("catch", start, self.last_end, target, body))
        elif not self.word("finally"):
            raise self.fail()
        if self.word("finally"):
            self.step()
            parts.append(self.block())
        return ("many", parts)

    def on_return(self) -> tuple:
        self.step(True)
        if self.at(";", "}") or self.token.kind == EOF or self.token.line_before:
            self.end_statement()
            return NOTHING
        out = self.expression()
        self.end_statement()
        return out

    def on_throw(self) -> tuple:
        self.step(True)
        if self.token.line_before:
            raise self.fail()
        out = self.expression()
        self.end_statement()
        return out

    def on_break(self) -> tuple:
        self.step()
        if self.token.kind == NAME and not self.token.line_before and self.token.value not in HARD:
            self.step()
        self.end_statement()
        return NOTHING

    on_continue = on_break

    def on_debugger(self) -> tuple:
        self.step()
        self.end_statement()
        return NOTHING

    def on_export(self) -> tuple:
        return self.export()

    def import_(self) -> tuple:
        self.step()
        names = []
        if self.token.kind == STRING:
            self.step()
        else:
            if self.token.kind == NAME:
                names.append(self.binding())
                if not self.accept(","):
                    return self.import_from(names)
            if self.accept("*"):
                self.expect_word("as")
                names.append(self.binding())
            else:
                self.expect("{")
                while not self.accept("}"):
                    first = self.step()
                    if first.kind not in (NAME, STRING):
                        raise self.fail(first)
                    if self.word("as"):
                        self.step()
                        names.append(self.binding())
                    else:
                        if first.kind == STRING or first.value in RESERVED:
                            raise self.fail(first)
                        names.append(("id", first.value, first.start, first.end, "import"))
                    if not self.at("}"):
                        self.expect(",")
            return self.import_from(names)
        return self.import_end(names)

    def import_from(self, names: list) -> tuple:
        self.expect_word("from")
        if self.token.kind != STRING:
            raise self.fail()
        self.step()
        return self.import_end(names)

    def import_end(self, names: list) -> tuple:
        self.attributes()
        self.end_statement()
        return ("variables", "import", [(x, None) for x in names])

    def attributes(self) -> None:
        if self.word("with", "assert") and not self.token.line_before:
            self.step()
            if not self.at("{"):
                raise self.fail()
            self.object()

    def export(self) -> tuple:
        self.step()
        if self.accept("*"):
            if self.word("as"):
                self.step()
                self.step()
            self.expect_word("from")
            self.step()
            self.attributes()
            self.end_statement()
            return NOTHING
        if self.word("default"):
            self.step(True)
            if self.word("function") or self.word("async") and self.peek().value == "function" and not self.peek().line_before:
                return self.function(True, False)
            if self.word("class") or self.at("@"):
                parts = [self.decorators()] if self.at("@") else []
                return ("many", [*parts, self.class_(True, False)])
            out = self.assignment()
            self.end_statement()
            return out
        if self.accept("{"):
            names = []
            while not self.accept("}"):
                first = self.step()
                if first.kind not in (NAME, STRING):
                    raise self.fail(first)
                if self.word("as"):
                    self.step()
                    if self.step().kind not in (NAME, STRING):
                        raise self.fail()
                    names.append((first, ""))
                else:
                    names.append((first, "export"))
                if not self.at("}"):
                    self.expect(",")
            if self.word("from"):
                self.step()
                self.step()
                self.attributes()
                self.end_statement()
                return NOTHING
            self.end_statement()
            for first, _ in names:
                if first.kind == STRING or first.value in RESERVED:
                    raise self.fail(first)
            return ("many", [("id", x.value, x.start, x.end, form) for x, form in names])
        if self.word("var", "let", "const", "function", "class", "async") or self.at("@"):
            return self.statement(True)
        raise self.fail()

    # bindings

    def binding(self) -> tuple:
        token = self.token
        if token.kind != NAME or token.value in HARD:
            raise self.fail()
        self.step()
        return ("id", token.value, token.start, token.end, "")

    def pattern(self) -> tuple:
        self.rescan()
        if self.at("["):
            out = self.array()
        elif self.at("{"):
            out = self.object()
        else:
            return self.binding()
        self.settle(out)
        check_pattern(out, self)
        return out

    def settle(self, node: tuple) -> None:
        """The node is a pattern, so its `a = 1` are fine."""
        if not self.half:
            return
        stack = [node]
        while stack:
            x = stack.pop()
            if x[0] == "object":
                for _, value in x[1]:
                    if value[0] == "assign" and value[1][0] == "id":
                        self.half.discard(value[1][2])
                    stack.append(value)
            elif x[0] == "array":
                stack += x[1]
            elif x[0] in ("assign", "spread", "paren"):
                stack.append(x[1])
            elif x[0] == "many":
                stack += x[1]

    # functions and classes

    def function(self, declared: bool, named: bool = True) -> tuple:
        start = self.token.start
        async_ = self.word("async")
        if async_:
            self.step()
        self.expect_word("function")
        star = self.accept("*")
        name = None
        if not self.at("("):
            name = self.binding()
        elif declared and named:
            raise self.fail()
        params, body = self.function_rest(async_, star)
        return ("function", "declaration" if declared else "expression", start, self.last_end, name, params, body)

    def function_rest(self, async_: bool, star: bool) -> tuple[list, list]:
        before = self.in_async, self.in_generator
        self.in_async, self.in_generator, self.depth = async_, star, self.depth + 1
        self.expect("(")
        params = []
        while not self.accept(")"):
            if self.accept("..."):
                params.append(("spread", self.pattern()))
            else:
                target = self.pattern()
                if self.accept("="):
                    target = ("assign", target, self.assignment())
                params.append(target)
            if not self.at(")"):
                self.expect(",")
        if not self.at("{"):
            raise self.fail()
        self.step(True)
        body = self.function_body()
        self.in_async, self.in_generator = before
        self.depth -= 1
        return params, body

    def function_body(self) -> list:
        """From after the brace on. What follows a body is no expression, but a statement may follow, so no rescan here."""
        return self.statements()

    def method(self, async_: bool, star: bool) -> tuple:
        start = self.token.start
        params, body = self.function_rest(async_, star)
        return ("function", "method", start, self.last_end, None, params, body)

    def decorators(self) -> tuple:
        parts = []
        while self.accept("@"):
            if self.at("("):
                parts.append(self.paren())
            else:
                parts.append(self.subscripts(self.binding()))
        return ("many", parts)

    def class_(self, declared: bool, named: bool = True) -> tuple:
        start = self.expect_word("class").start
        name = heritage = None
        if self.token.kind == NAME and not self.word("extends"):
            name = self.binding()
        elif declared and named:
            raise self.fail()
        if self.word("extends"):
            self.step(True)
            heritage = self.left_hand()
        self.expect("{")
        members = []
        while not self.accept("}"):
            if self.accept(";"):
                continue
            members.append(self.member())
        return ("class", declared, start, self.last_end, name, heritage, members)

    def member(self) -> tuple:
        parts = [self.decorators()] if self.at("@") else []
        start = self.token.start
        static = async_ = star = False

        def is_key_end() -> bool:
            return self.at("(", "=", ";", "}") or self.token.kind == EOF

        if self.word("static"):
            after = self.peek()
            if after.kind == PUNCT and after.value == "{":
                self.step()
                self.step(True)
                before = self.in_async, self.in_generator
                self.in_async = self.in_generator = False
                body = self.statements()
                self.in_async, self.in_generator = before
                return ("scope", "static", start, self.last_end, body)
            static = not (after.kind == PUNCT and after.value in ("(", "=", ";", "}"))
            if static:
                self.step()
        key = None
        if self.word("async") and not ((a := self.peek()).kind == PUNCT and a.value in ("(", "=", ";", "}") or a.line_before):
            self.step()
            async_ = True
        if self.accept("*"):
            star = True
        if not async_ and not star and self.word("get", "set", "accessor") and not ((a := self.peek()).kind == PUNCT and a.value in ("(", "=", ";", "}")):
            if not (a.line_before and self.word("accessor")):
                self.step()
        key = self.key(True)
        if self.at("("):
            return ("many", [*parts, key, self.method(async_, star)])
        if async_ or star:
            raise self.fail()
        value = NOTHING
        if self.accept("="):
            before = self.in_async, self.in_generator
            self.in_async = self.in_generator = False
            value = self.assignment()
            self.in_async, self.in_generator = before
        self.end_statement()
        return ("many", [*parts, key, value])

    def key(self, private: bool = False) -> tuple:
        """A property's name; what is computed in it."""
        token = self.token
        if token.kind in (NAME, STRING, NUMBER) or private and token.kind == PRIVATE:
            self.step()
            return NOTHING
        self.expect("[")
        self.rescan()
        out = self.assignment()
        self.expect("]")
        return out

    # expressions

    def expression(self, with_in: bool = True) -> tuple:
        first = self.assignment(with_in)
        if not self.at(","):
            return first
        parts = [first]
        while self.accept(","):
            parts.append(self.assignment(with_in))
        return ("many", parts)

    def assignment(self, with_in: bool = True) -> tuple:
        self.rescan()
        token = self.token
        if token.kind == NAME:
            if self.word("yield") and self.in_generator:
                self.step()
                if self.token.line_before or self.at(")", "]", "}", ",", ";", ":") or self.token.kind == EOF or self.word("in", "of"):
                    return NOTHING
                self.accept("*")
                return self.assignment(with_in)
            if token.value not in HARD:
                after = self.peek()
                if after.kind == PUNCT and after.value == "=>" and not after.line_before:
                    target = self.binding()
                    return self.arrow(token.start, [target], False, with_in)
                if self.word("async") and not after.line_before:
                    if after.kind == NAME and after.value not in HARD:
                        at, kept, last = self.lexer.at, self.token, self.last_end
                        self.step()
                        target = self.binding()
                        if self.at("=>"):
                            return self.arrow(token.start, [target], True, with_in)
                        self.lexer.at, self.token, self.last_end = at, kept, last
        left = self.conditional(with_in)
        if self.at("=>") and left[0] == "params" and not self.token.line_before:
            return self.arrow(left[2], left[1], left[3], with_in)
        if left[0] == "params":
            raise self.fail()
        if self.token.kind == PUNCT and self.token.value in ASSIGN:
            if left[0] in ("object", "array"):
                if self.token.value != "=":
                    raise self.fail()
                self.settle(left)
            elif not (left[0] == "id" or left[0] == "paren" and left[1][0] in ("id", "target") or left[0] == "target"):
                raise self.lexer.error("Invalid assignment target", self.token.start)
            self.step(True)
            return ("assign", left, self.assignment(with_in))
        return left

    def arrow(self, start: int, params: list, async_: bool, with_in: bool) -> tuple:
        for x in params:
            self.settle(x)
            check_pattern(x, self)
        self.expect("=>")
        self.rescan()
        before = self.in_async, self.in_generator
        self.in_async, self.in_generator, self.depth = async_ or self.depth == 0 and self.in_async, False, self.depth + 1
        if self.at("{"):
            self.step(True)
            body = self.function_body()
        else:
            body = [self.assignment(with_in)]
        self.in_async, self.in_generator = before
        self.depth -= 1
        return ("function", "arrow", start, self.last_end, None, params, body)

    def conditional(self, with_in: bool) -> tuple:
        test = self.binary(with_in)
        if not self.at("?") or test[0] == "params":
            return test
        self.step(True)
        yes = self.assignment()
        self.expect(":")
        return ("many", [test, yes, self.assignment(with_in)])

    def binary(self, with_in: bool) -> tuple:
        """Operands of a chain of operators; precedence leaves no trace in names."""
        if self.token.kind == PRIVATE:
            self.step()
            if not self.word("in"):
                raise self.fail()
        parts = [self.unary()] if not self.word("in") else []
        while True:
            token = self.token
            if token.kind == PUNCT and token.value in BINARY or token.kind == NAME and (self.word("instanceof") or with_in and self.word("in")):
                if parts and parts[-1][0] == "params":
                    raise self.fail()
                self.step(True)
                if self.token.kind == PRIVATE:
                    self.step()
                    continue
                parts.append(self.unary())
            else:
                return parts[0] if len(parts) == 1 else ("many", parts)

    def unary(self) -> tuple:
        self.rescan()
        deep = False
        while True:
            token = self.token
            if token.kind == PUNCT and token.value in ("!", "~", "+", "-", "++", "--") or token.kind == NAME and (self.word("typeof", "void", "delete") or self.word("await") and self.in_async):
                self.step(True)
                deep = True
                continue
            break
        out = self.left_hand()
        if self.at("++", "--") and not self.token.line_before:
            self.step()
            deep = True
        return ("many", [out]) if deep else out

    def left_hand(self) -> tuple:
        self.rescan()
        token = self.token
        if self.word("new"):
            self.step(True)
            if self.accept("."):
                self.step()
                return self.subscripts(NOTHING)
            target = self.left_hand_new()
            parts = [target]
            if self.at("("):
                parts += self.arguments()
            return self.subscripts(("many", parts))
        if self.word("import"):
            self.step()
            if self.accept("."):
                self.step()
                if self.at("("):
                    return self.subscripts(("many", self.arguments()))
                return self.subscripts(NOTHING)
            if not self.at("("):
                raise self.fail()
            return self.subscripts(("many", self.arguments()))
        if self.word("async") and (a := self.peek()).kind == PUNCT and a.value == "(" and not a.line_before:
            name = self.binding()
            parts = self.arguments()
            if self.at("=>") and not self.token.line_before:
                return ("params", parts, token.start, True)
            for x in parts:
                if x[0] == "object" and self.half:
                    break
            return self.subscripts(("many", [name, *parts]))
        return self.subscripts(self.primary())

    def left_hand_new(self) -> tuple:
        """What follows ``new``: members, but no calls."""
        self.rescan()
        if self.word("new"):
            self.step(True)
            if self.accept("."):
                self.step()
                return self.subscripts(NOTHING, False)
            inner = self.left_hand_new()
            return self.subscripts(("many", [inner, *(self.arguments() if self.at("(") else [])]), False)
        return self.subscripts(self.primary(), False)

    def subscripts(self, base: tuple, calls: bool = True) -> tuple:
        if base[0] == "params":
            return base
        parts, last = [base], None
        while True:
            if self.at("."):
                self.step()
                if self.token.kind not in (NAME, PRIVATE):
                    raise self.fail()
                self.step()
                last = "target"
            elif self.at("?."):
                if not calls:
                    raise self.fail()
                self.step()
                if self.at("("):
                    parts += self.arguments()
                elif self.at("["):
                    parts.append(self.key())
                elif self.token.kind == TEMPLATE:
                    raise self.fail()
                else:
                    if self.token.kind not in (NAME, PRIVATE):
                        raise self.fail()
                    self.step()
                last = "many"
            elif self.at("["):
                self.step(True)
                parts.append(self.expression())
                self.expect("]")
                last = "target"
            elif self.at("(") and calls:
                parts += self.arguments()
                last = "many"
            elif self.token.kind == TEMPLATE:
                parts.append(self.template())
                last = "many"
            else:
                return base if last is None else (last, parts)

    def arguments(self) -> list:
        self.expect("(")
        self.rescan()
        out = []
        while not self.accept(")"):
            if self.accept("..."):
                out.append(("spread", self.assignment()))
            else:
                out.append(self.assignment())
            if not self.at(")"):
                self.expect(",")
                self.rescan()
        return out

    def template(self) -> tuple:
        parts = []
        self.lexer.at = self.token.end
        while self.lexer.template_part():
            self.token = self.lexer.next(True)
            parts.append(self.expression())
            if not self.at("}"):
                raise self.fail()
            self.lexer.at = self.token.end
        self.last_end = self.lexer.at
        self.token = self.lexer.next(False)
        return ("many", parts)

    def primary(self) -> tuple:
        self.rescan()
        token = self.token
        if token.kind == NAME:
            plain = token.end - token.start == len(token.value)
            if plain:
                if token.value == "function":
                    return self.function(False)
                if token.value == "async" and (a := self.peek()).kind == NAME and a.value == "function" and not a.line_before:
                    return self.function(False)
                if token.value == "class":
                    return self.class_(False)
                if token.value in ("this", "null", "true", "false", "super"):
                    self.step()
                    if token.value == "super" and not self.at("(", ".", "["):
                        raise self.fail()
                    return NOTHING
            if token.value in HARD:
                raise self.fail()
            self.step()
            return ("id", token.value, token.start, token.end, "")
        if token.kind in (NUMBER, STRING, REGEX):
            self.step()
            return NOTHING
        if token.kind == TEMPLATE:
            return self.template()
        if self.at("("):
            return self.paren()
        if self.at("["):
            return self.array()
        if self.at("{"):
            return self.object()
        if self.at("@"):
            decorators = self.decorators()
            return ("many", [decorators, self.class_(False)])
        raise self.fail()

    def paren(self) -> tuple:
        """An expression in parentheses, or an arrow function's parameters."""
        start = self.expect("(").start
        self.rescan()
        parts, only_params = [], False
        while not self.at(")"):
            if self.accept("..."):
                parts.append(("spread", self.pattern()))
                only_params = True
            else:
                parts.append(self.assignment())
            if self.at(")"):
                break
            self.expect(",")
            self.rescan()
            if self.at(")"):
                only_params = True
        self.expect(")")
        if self.at("=>") and not self.token.line_before:
            return ("params", parts, start, False)
        if only_params or not parts:
            raise self.fail()
        return ("paren", parts[0] if len(parts) == 1 else ("many", parts))

    def array(self) -> tuple:
        self.expect("[")
        self.rescan()
        out = []
        while not self.accept("]"):
            if self.accept(","):
                self.rescan()
                continue
            if self.accept("..."):
                out.append(("spread", self.assignment()))
            else:
                out.append(self.assignment())
            if not self.at("]"):
                self.expect(",")
                self.rescan()
        return ("array", out)

    def object(self) -> tuple:
        self.expect("{")
        out = []
        while not self.accept("}"):
            if self.accept("..."):
                out.append((None, ("spread", self.assignment())))
            else:
                out.append(self.property())
            if not self.at("}"):
                self.expect(",")
        return ("object", out)

    def property(self) -> tuple:
        token = self.token
        async_ = star = False
        ends = ("(", ",", ":", "}", "=")
        if self.word("async") and not ((a := self.peek()).kind == PUNCT and a.value in ends or a.line_before):
            self.step()
            async_ = True
        if self.accept("*"):
            star = True
        if async_ or star:
            return self.key(), self.method(async_, star)
        if self.word("get", "set") and not ((a := self.peek()).kind == PUNCT and a.value in ends):
            self.step()
            return self.key(), self.method(False, False)
        key = self.key()
        if self.at("("):
            return key, self.method(False, False)
        if self.accept(":"):
            return key, self.assignment()
        if token.kind != NAME or token.value in HARD:
            raise self.fail()
        name = ("id", token.value, token.start, token.end, "short")
        if self.at("="):
            self.half.add(token.start)
            self.step(True)
            return key, ("assign", name, self.assignment())
        return key, name


#: Statements that begin with a word of their own.
STATEMENTS = frozenset("var const function class if while with do for switch try return throw break continue debugger export".split())


def check_pattern(node: tuple, parser: Parser) -> None:
    """Fails unless the node can bind names."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x[0] == "object":
            stack += [value for _, value in x[1]]
        elif x[0] == "array":
            stack += x[1]
        elif x[0] in ("assign", "spread"):
            stack.append(x[1])
        elif x[0] != "id":
            raise parser.lexer.error("Invalid binding pattern", parser.last_end)
