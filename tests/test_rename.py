"""Renaming scenarios, all in one table: each row has a source and a scripted renamer."""

import re

import pytest
from pyspark.sql import functions as F

from scopeframe.jsparse import analyse
from scopeframe.operators import emit, parse, resolve, suggest, worklist
from scopeframe.plans.rename import rename

# name: source, kind of renamer, its argument, context size
CASES = {
    "no_op": ("let rate = 0.5, tax;", "identity", None, 500),
    "empty": ("", "identity", None, 500),
    "simple": ("var total = 40 + 2;", "fixed", "answer", 200),
    "across_scopes": ("let hits = 0; const bump = () => { hits += 1; };", "mapping", {"hits": "visits"}, 500),
    "largest_first": ("go(); { let near = 1; } var far = 2;", "queue", ["wide", "tight"], 500),
    "shadowed": ("let row = 0; { let row = 1; use(row); } use(row);", "queue", ["outer", "inner"], 500),
    "methods": ("class Tank { fill() { return this.level; } } new Tank().fill();", "suffix", "Kind", 500),
    "properties": ("var key = 'k'; var bag = { key: 1, other: key }; bag.key + bag[key];", "mapping", {"key": "name", "bag": "store"}, 500),
    "invalid": ("let n = 3;", "fixed", "self.node-count", 500),
    "space": ("let n = 3;", "fixed", "node count", 500),
    "reserved": ("let n = 3;", "fixed", "while", 500),
    "global": ("let out = 7; console.log(out);", "fixed", "console", 500),
    "global_below": ("let pi = 3; const area = r => Math.abs(r) * pi;", "mapping", {"pi": "Math"}, 500),
    "global_beside": ("{ fetch(1); } { let url = 2; send(url); }", "mapping", {"url": "fetch"}, 500),
    "same_name": ("let p = 1, q = 2, r = 3;", "fixed", "point", 500),
    "later_name": ("let left = 1; let right = 2;", "fixed", "right", 500),
    "siblings": ("{ let i = 1; } { let j = 2; }", "mapping", {"i": "step", "j": "step"}, 500),
    "same_scope": ("let i = 1; let j = 2;", "mapping", {"i": "step", "j": "step"}, 500),
    "nested": ("let i = 1; { let j = 2; use(i, j); }", "mapping", {"i": "step", "j": "step"}, 500),
    "disjoint": (" ".join(f"for (let k{i} of list) use(k{i});" for i in range(12)), "mapping", {f"k{i}": "item" for i in range(12)}, 500),
    "descendant": ("let sum = 0; { let part = 1; sum += part; }", "mapping", {"sum": "part"}, 500),
    "numbers": ("let x = 1; let y = 2; let z = 3;", "mapping", {"x": "col7", "y": "col7", "z": "col7"}, 500),
    "arguments": ("var pick = function () { return arguments[0]; };", "fixed", "first", 500),
    "unicode": ("let größe = 'µ'; put(größe);", "fixed", "size", 500),
    "private": ("class Safe { #pin = 4; open(t) { return t === this.#pin; } }", "identity", None, 500),
    "short": ("let w = 1; draw({w, h: w}); let {top, low = w} = box; draw(top, low);", "suffix", "_n", 500),
    "modules": ("import main, {one, two as deux} from 'lib'; export {one, deux as zwei}; export let four = main;", "suffix", "_n", 500),
    "noop_clash": ("let v = 1; { let v = 2; }", "queue", ["v!", "v"], 500),
    "broken": ("let ] = 1", "fixed", "b", 500),
}


def scripted(kind, arg):
    return {"identity": lambda: suggest.identity(), "fixed": lambda: suggest.fixed(arg), "suffix": lambda: suggest.suffix(arg), "queue": lambda: suggest.queue(arg), "mapping": lambda: suggest.mapping(arg)}[kind]()


@pytest.fixture(scope="module")
def outputs(spark):
    sources = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "source_id string, code string")
    parsed = parse.parse(sources).cache()
    said = None
    for k, (_, kind, arg, size) in CASES.items():
        x = scripted(kind, arg).suggest(worklist.worklist(parsed.where(F.col("source_id") == k), size))
        said = x if said is None else said.unionByName(x)
    said = said.cache()
    both = []
    for by_family in (True, False):
        out = emit.rewrite(parsed, resolve.resolve(parsed, said, by_family)).collect()
        both.append({x["source_id"]: x for x in out})
    assert both[0] == both[1]
    return both[0]


def count(text, name):
    return len(re.findall(rf"(?<![\w$]){re.escape(name)}(?![\w$])", text))


EXACT = {
    "no_op": "let rate = 0.5, tax;",
    "empty": "",
    "simple": "var answer = 40 + 2;",
    "across_scopes": "let visits = 0; const bump = () => { visits += 1; };",
    "largest_first": "go(); { let tight = 1; } var wide = 2;",
    "shadowed": "let outer = 0; { let inner = 1; use(inner); } use(outer);",
    "methods": "class TankKind { fill() { return this.level; } } new TankKind().fill();",
    "properties": "var name = 'k'; var store = { key: 1, other: name }; store.key + store[name];",
    "invalid": "let selfNodeCount = 3;",
    "space": "let nodeCount = 3;",
    "reserved": "let _while = 3;",
    "global": "let console2 = 7; console.log(console2);",
    "global_below": "let Math2 = 3; const area = r => Math.abs(r) * Math2;",
    "global_beside": "{ fetch(1); } { let fetch = 2; send(fetch); }",
    "same_name": "let point = 1, point2 = 2, point3 = 3;",
    "later_name": "let right2 = 1; let right = 2;",
    "siblings": "{ let step = 1; } { let step = 2; }",
    "same_scope": "let step = 1; let step2 = 2;",
    "descendant": "let part2 = 0; { let part = 1; part2 += part; }",
    "numbers": "let col7 = 1; let col8 = 2; let col9 = 3;",
    "arguments": "var first = function () { return arguments[0]; };",
    "unicode": "let size = 'µ'; put(size);",
    "private": "class Safe { #pin = 4; open(t) { return t === this.#pin; } }",
    "short": "let w_n = 1; draw({w: w_n, h: w_n}); let {top: top_n, low: low_n = w_n} = box; draw(top_n, low_n);",
    "modules": "import main_n, {one as one_n, two as deux_n} from 'lib'; export {one_n as one, deux_n as zwei}; export let four_n = main_n;",
    "noop_clash": "let v2 = 1; { let v = 2; }",
}


@pytest.mark.parametrize("case", EXACT)
def test_output(outputs, case):
    assert outputs[case]["output"] == EXACT[case]


def test_nested_gets_one_number(outputs):
    text = outputs["nested"]["output"]
    assert "step2" in text and "step3" not in text and "_step" not in text


def test_disjoint_scopes_stay_bare(outputs):
    assert count(outputs["disjoint"]["output"], "item") == 24


def test_broken_source_keeps_its_row(outputs):
    assert outputs["broken"]["output"] is None and outputs["broken"]["parse_error"]


def graph(code):
    """Which declaration each name goes to, by ordinal, names apart."""
    found = analyse(code)
    return [(x[1], x[2]) for x in found.references], [(x[1], x[2]) for x in found.scopes]


@pytest.mark.parametrize("case", [k for k in CASES if k not in ("broken", "empty")])
def test_bindings_are_kept(outputs, case):
    before, after = graph(CASES[case][0]), graph(outputs[case]["output"])
    assert before == after


LAYERS = "var shop = 'x';\nfunction order(list) {\n  let sum = 0;\n  class Line {\n    cost(n) {\n      var net = n * 2;\n      return net;\n    }\n  }\n  return sum;\n}\n"
CONTEXTS = [
    # source, size, symbol, exact, contains, lacks
    (LAYERS, 500, "net", None, ["(n) {", "var net = n * 2"], []),
    ("let tiny = 0;", 500, "tiny", "let tiny = 0;", [], []),
    ("let away = 5; function here() { let close = away; }", 30, "close", None, ["function here"], ["let away"]),
    ("while (go) { for (;;) { try { let deep = 1; run(deep); } finally {} } }", 200, "deep", None, ["let deep = 1", "run(deep)"], []),
    ("function long() { let one = 1; let two = 2; let three = 3; let four = 4; }", 20, "one", None, [], ["let four = 4"]),
    ("var self = 0; g(self);", 0, "self", "self", [], []),
    (";{ let q = 1; }", 0, "q", "", [], []),
    ("let k = 1; " + "go();" * 20, 20, "k", "let k = 1; go();go()", [], []),
    ("go();" * 20 + "let k = 1;", 20, "k", "go();go();let k = 1;", [], []),
    ("go();" * 20 + "var wxyz;" + "go();" * 20, 10, "wxyz", ";var wxyz;go()", [], []),
    ("// " + "λ" * 400 + "\nlet mid = 1; // " + "λ" * 400, 50, "mid", None, ["let mid = 1"], ["\ufffd"]),
]


@pytest.fixture(scope="module")
def contexts(spark):
    out = {}
    for size in {c[1] for c in CONTEXTS}:
        rows = [(str(i), c[0]) for i, c in enumerate(CONTEXTS) if c[1] == size]
        listed = worklist.worklist(parse.parse(spark.createDataFrame(rows, "source_id string, code string")), size)
        for x in listed.collect():
            out[x["source_id"], x["name"]] = x
    return out


@pytest.mark.parametrize("i", range(len(CONTEXTS)))
def test_context(contexts, i):
    _, size, symbol, exact, contains, lacks = CONTEXTS[i]
    text = contexts[str(i), symbol]["surrounding"]
    if exact is not None:
        assert text == exact
    for x in contains:
        assert x in text
    for x in lacks:
        assert x not in text


def test_middle_window_may_be_longer(contexts):
    text = contexts["9", "wxyz"]["surrounding"]
    assert "wxyz" in text and len(text) == 10 + len("wxyz")


@pytest.mark.parametrize(
    "code, names",
    [
        (LAYERS, ["shop", "order", "list", "sum", "Line", "n", "net"]),
        ("go(); { let a = 1; { let b = 2; { let c = 3; } } } let d = 4;", ["d", "a", "b", "c"]),
        ("const mix = (red, green, blue) => red + green + blue;", ["mix", "red", "green", "blue"]),
    ],
)
def test_order(spark, code, names):
    rows = worklist.worklist(parse.parse(spark.createDataFrame([("s", code)], "source_id string, code string")))
    assert [x["name"] for x in rows.orderBy("ord").collect()] == names


def test_plan_with_work_path(spark, tmp_path):
    from pyspark.sql import Observation

    seen = Observation()
    done = rename(spark.createDataFrame([("s", "var old = 1")], "source_id string, code string"), suggest.fixed("fresh"), work_path=f"file://{tmp_path}/w", observation=seen)
    assert done.output.first()["output"] == "var fresh = 1"
    assert [(x["name"], x["new_name"]) for x in done.log().collect()] == [("old", "fresh")]
    assert seen.get["identifiers"] == 1


def test_family_fold_equals_source_fold_on_random_trees():
    """The per-family fold and the fold over all names of a source decide alike."""
    import random

    from scopeframe.operators.resolve import Family

    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 7)
        parents = [None] + [rng.randrange(i) for i in range(1, n)]
        children = {i: [j for j in range(n) if parents[j] == i] for i in range(n)}
        enter, exit_, clock = {}, {}, 0

        def tour(s):
            nonlocal clock
            enter[s] = clock
            clock += 1
            for c in children[s]:
                tour(c)
            exit_[s] = clock

        tour(0)
        words = ["a", "b", "a2", "b3", "c"]
        symbols, used = [], set()
        for k in range(rng.randint(1, 9)):
            s, w = rng.randrange(n), rng.choice(words)
            if (s, w) not in used:
                used.add((s, w))
                symbols.append((k, w, s, rng.choice(words)))
        free = [(rng.choice(words), rng.randrange(n)) for _ in range(rng.randint(0, 3))]
        stem = lambda x: x.rstrip("0123456789") or x

        def fold(group):
            families, out = {}, {}
            get = lambda w: families.setdefault(group(w), Family())
            for w, s in free:
                get(w).free.setdefault(w, []).append(enter[s])
            for f in families.values():
                for uses in f.free.values():
                    uses.sort()
            for k, w, s, _ in symbols:
                get(w).add(w, enter[s], exit_[s], k)
            for k, w, s, base in symbols:
                if base != w:
                    out[k] = get(base).resolve(base, enter[s], exit_[s], k)
                    get(w).drop(w, enter[s], exit_[s], k)
                    get(base).add(out[k], enter[s], exit_[s], k)
            return out

        assert fold(stem) == fold(lambda w: "")


def test_spans_look_back_like_a_walk():
    import random

    rng = random.Random(8)
    held, found = [], resolve.Spans()
    found.BLOCK = 3
    for _ in range(3000):
        a = rng.randrange(300)
        span = (a, a + rng.randint(1, 40), rng.randrange(5))
        if held and rng.random() < 0.35:
            gone = rng.choice([*held, span])
            found.drop(gone)
            if gone in held:
                held.remove(gone)
        else:
            found.add(span)
            held.append(span)
        place, end = rng.randrange(310), rng.randrange(340)
        around = [x for x in held if x[0] <= place < x[1]]
        assert found.around(place) == (max(around) if around else None)
        assert found.begins_within(place, end) == any(place < x[0] < end for x in held)


def test_a_symbol_with_two_names_is_refused(spark):
    parsed = parse.parse(spark.createDataFrame([("s", "let a = 1, b = 2, c = a;")], "source_id string, code string"))
    some = spark.createDataFrame([("s", 2, "z")], "source_id string, symbol_id int, new_name string")
    assert emit.rewrite(parsed, some).first()["output"] == "let a = 1, b = 2, z = a;"
    with pytest.raises(Exception, match="two new names"):
        emit.rewrite(parsed, some.unionByName(some)).collect()
