import pytest

from scopeframe.jsparse import ParseError, analyse

GOOD = [
    "a\n/b/g.exec(c)",
    "x = a / b / c; y = /[/]\\/x/g.test(s)",
    "`t ${a + `n ${b}`} x`; tag`q${1}`",
    "let f = async (x, {y, z = x}) => { for await (const k of y) {} }",
    "({a, b = 2} = {a, c})",
    "class A { static { var q = 1 } async *gen() { yield* x } get y() { return this.#p } #p = 1; static async m() {} static = 3 }",
    "label: for (;;) { continue label }",
    "try {} catch {}",
    "import d, * as n from 'm'; import 's'; export * as q from 'x'; export default class {}",
    "a?.b?.[c]?.(d) ?? e; a ||= 1; b **= 2",
    "async () => {}; async(1); async x => x",
    "#!/usr/bin/env node\nx",
    "if (a) b; else if (c) d; else e",
    "var \\u0061bc = 1; abc",
    "x = a ? (b) : c => d",
    "for (const [k, v] of Object.entries(o)) if (k in v) delete v[k]",
]
BAD = ["const = 1", "a b", "({a=1})", "(a,)", "foo(", "`abc", '"a', "1 = 2", "function (){}", "}", "class A { x y }", "() + 1", "a?.b = 1", "/* x", "var class = 1", "import {a} fro 'x'"]


@pytest.mark.parametrize("code", GOOD)
def test_accepts(code):
    analyse(code)


@pytest.mark.parametrize("code", BAD)
def test_rejects(code):
    with pytest.raises(ParseError):
        analyse(code)


def names(code):
    found = analyse(code)
    return [s[1] for s in found.symbols], sorted({r[0] for r in found.references if r[1] is None})


@pytest.mark.parametrize(
    "code, bound, free",
    [
        ("function f(a, {b, c: [d]}, ...e) { return a + g }", ["f", "a", "b", "d", "e"], ["g"]),
        ("{ let a; var b; } a; b", ["a", "b"], ["a"]),
        ("x = function g() { return g }; g", ["g"], ["g", "x"]),
        ("try {} catch ({m}) { m } m", ["m"], ["m"]),
        ("use(v); var v; let {w = v} = o", ["v", "w"], ["o", "use"]),
        ("a.b.c; ({d: e, [f]: 1})", [], ["a", "e", "f"]),
        ("class K extends B { m() { K } } ", ["K"], ["B"]),
        ("function f() { return arguments }", ["f"], ["arguments"]),
        ("var a; var a; function a() {}", ["a"], []),
        ("export {x as y} from 'm'; export {z}", [], ["z"]),
        ("for (let i = 0; i < n; i++) { let i = 1 } i", ["i", "i"], ["i", "n"]),
        ("async (a) => a; async(b)", ["a"], ["async", "b"]),
    ],
)
def test_names(code, bound, free):
    assert names(code) == (bound, free)


@pytest.mark.parametrize(
    "code",
    [
        "let a; let a", "const a = 1; class a {}", "let a; var a", "var a; let a", "function a() {} let a", "let a; function a() {}", "class a {} class a {}",
        "let [a, {b: a}] = c", "{ let a; { var a } }", "{ { var a } let a }", "{ var {x: [a]} = 1; const a = 2 }", "function f(a) { let a }", "function f(a, a) {}",
        "(a, [a]) => 1", "try {} catch (e) { let e }", "try {} catch ([e, e]) {}", "import a from 'm'; let a", "import {a, b as a} from 'm'", "for (let i of j) { var i }",
        "switch (x) { case 1: let a; case 2: let a }",
    ],
)
def test_names_are_declared_once(code):
    with pytest.raises(ParseError, match="declared already"):
        analyse(code)


@pytest.mark.parametrize(
    "code",
    [
        "var a; var a", "var a; function a() {}", "let a; { let a }", "let a; { { let a } }", "function f(a) { var a; function a() {} }", "function f(a) { { let a } }",
        "try {} catch (e) { var e }", "try {} catch (e) { { let e } }", "let f = function f() { let f }", "class C { m(C) { let D } }", "{ var a } let b", "() => { var a } ; let a",
        "for (let i = 0;;) { let i }", "function f() { var a; { var a } } { let a }", "if (x) { let a } else { let a }", "for (var i of j); for (var i of j);",
    ],
)
def test_names_may_be_declared_again_elsewhere(code):
    analyse(code)


def test_offsets_are_bytes():
    found = analyse("const café = 1; function f(a) { return café + a }")
    assert found.symbols[0][3:5] == (6, 11)
    code = "const café = 1; function f(a) { return café + a }".encode()
    for name, _, _, a, b, _ in found.references:
        assert code[a:b].decode() == name


def test_scopes_nest():
    found = analyse("function f() { { let a } class C { m() {} } } (() => 1)()")
    for _, parent, _, start, end, enter, exit_ in found.scopes[1:]:
        p = found.scopes[parent]
        assert p[3] <= start <= end <= p[4] and p[5] < enter < exit_ <= p[6]
