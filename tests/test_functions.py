"""Column functions, by tables of input and result."""

import json

import pytest
from pyspark.sql import functions as F

from scopeframe.functions import http, names, responses, texts
from scopeframe.observe import bar
from scopeframe.operators.resolve import split_suffix
from scopeframe.providers import strategies
from scopeframe.providers.http import NotSupported, Transient, error_for


def column(spark, rows, schema, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [x["out"] for x in df.select("i", make().alias("out")).orderBy("i").collect()]


SAFE = {
    "foo": "foo", "this.kLength": "thisKLength", "foo bar": "fooBar", "foo-bar-baz": "fooBarBaz", "a..b": "aB", "foo!?bar": "foobar", "": "_", "!!??": "_", "123abc": "_123abc",
    "static": "_static", "class": "_class", "let": "_let", "_foo": "_foo", "_static": "_static", "café": "café", "$dollar": "$dollar", "alreadyCamel": "alreadyCamel", "async": "async",
    ".a": "a", "a.": "a", "a.!b": "aB", "a._b": "a_b", "a.ßx": "aSSx", "a·b": "a·b", "aﷺb": "ab", "日本 語": "日本語", "a\nb": "ab",
}


def test_to_identifier(spark):
    out = column(spark, [(x,) for x in SAFE], "x string", lambda: names.to_identifier(F.col("x")))
    assert dict(zip(SAFE, out, strict=True)) == SAFE


def plain_identifier(raw):
    out, up = "", False
    for ch in raw:
        if ch in ". -":
            up = out != ""
        elif ch == "$" or ("a" + ch).isidentifier():
            out, up = out + (ch.upper() if up else ch), False
    out = out or "_"
    return "_" + out if out[0] in "0123456789" or out in names.RESERVED else out


def test_to_identifier_reads_whole_texts(spark, tmp_path):
    """No document is left out, and nothing of a text."""
    import __spark_entry__ as entry

    texts = [*SAFE, "Été à l'école.élève - über ßtraße año " * 30, "ascii words only, " * 20 + "dann größer. ähnlich", "x" * 5000 + " end", "a" * 39 + ".é", "12 日本. 語", None, "\n - .\u200d"]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "repeated id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in entry.queries()["to_identifier_texts"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, None if t is None else plain_identifier(t)) for i, t in rows), key=str)


def test_reserved(spark):
    words = {"static": True, "class": True, "let": True, "foo": False, "_static": False, "async": False}
    assert column(spark, [(x,) for x in words], "x string", lambda: names.is_reserved(F.col("x"))) == list(words.values())


def test_suffix(spark):
    rows = {"item2": ("item", 2), "a007": ("a", 7), "abc": ("abc", None), "123": ("123", None), "": ("", None), "a18446744073709551616": ("a", None), "a18446744073709551615": ("a", 18446744073709551615)}
    out = column(spark, [(x,) for x in rows], "x string", lambda: F.struct(names.stem(F.col("x")), names.numeric_suffix(F.col("x"))))
    assert [(a, None if b is None else int(b)) for a, b in out] == list(rows.values())
    assert [split_suffix(x)[:2] for x in rows] == list(rows.values())


def test_next_free(spark):
    rows = [("index", [], "index"), ("index", ["index"], "index2"), ("userAccountManager2", ["userAccountManager2"], "userAccountManager3"), ("index3", ["index3", "index4"], "index5"), ("a007", ["a007"], "a8")]
    assert column(spark, [r[:2] for r in rows], "b string, t array<string>", lambda: names.next_free(F.col("b"), F.col("t"))) == [r[2] for r in rows]


def error(**fields):
    return json.dumps({"error": fields})


HTTP = [
    *((s, "x", False) for s in (500, 502, 429, 408, 300)),
    (401, error(message="invalid api key"), False),
    (403, error(message="Unsupported parameter"), False),
    (400, error(message="Unsupported parameter: 'response_format'.", param="response_format"), True),
    (400, error(message="Unsupported value: 'tool_choice'.", param="tool_choice"), True),
    (400, json.dumps({"type": "error", "error": {"type": "invalid_request_error", "message": "Unrecognized request argument: response_format"}}), True),
    (400, error(message="Unknown parameter: response_format"), True),
    (400, error(message="Invalid value: response_format json_schema not supported on this model"), True),
    (400, error(message="response_format json_schema is not supported by this model"), True),
    (400, error(message="tool_choice required is not supported"), True),
    (400, error(message="json_schema mode not supported"), True),
    (400, error(message="Structured outputs are not supported for this model"), True),
    (400, error(message="Missing required header: anthropic-beta for structured outputs"), True),
    (400, error(param="response_format", message="some other phrasing entirely"), True),
    (400, error(message="The model 'gpt-9000' does not exist"), False),
    (400, error(message="Your request was rejected by content moderation"), False),
    (400, error(message="Invalid prompt format"), False),
    (400, "Bad Request", False),
    (400, "<html>...</html>", False),
    (400, "{not valid json", False),
    (404, error(message="not found"), False),
    (400, error(message="UNSUPPORTED PARAMETER: response_format"), True),
    (400, json.dumps({"error": "unsupported parameter"}), False),
    (400, "unsupported parameter", True),
    (400, error(message=5, param=["response_format"]), False),
]


def test_classify(spark):
    out = column(spark, [(s, b) for s, b, _ in HTTP], "s int, b string", lambda: http.classify(F.col("s"), F.col("b")))
    assert [x == http.NOT_SUPPORTED for x in out] == [x[2] for x in HTTP]
    assert [isinstance(error_for(s, b), NotSupported) for s, b, _ in HTTP] == [x[2] for x in HTTP]
    assert str(error_for(400, error(message="Unsupported parameter: foo"))) == "http 400: Unsupported parameter: foo"


T = responses.TOOL


def chat(content):
    return {"choices": [{"message": {"content": content}}]}


def tool(name, arguments):
    return {"choices": [{"message": {"tool_calls": [{"function": {"name": name, "arguments": arguments}}]}}]}


def blocks(*x):
    return {"content": list(x)}


GOOD = {"name": "x"}
BAD = object()
EXTRACT = [
    ("content", chat('{"name":"x"}'), GOOD),
    ("content", chat('﻿  {"name":"x"}'), GOOD),
    ("content", chat('```json\n{"name":"x"}\n```'), BAD),
    ("content", chat(None), BAD),
    ("content", chat(5), BAD),
    ("content", {"choices": []}, BAD),
    ("content", {}, BAD),
    ("content", {"choices": [{}]}, BAD),
    ("content", chat("not json"), BAD),
    ("tool_arguments", tool(T, '{"name":"x"}'), GOOD),
    ("tool_arguments", tool(T, '﻿\n{"name":"x"}'), GOOD),
    ("tool_arguments", tool("other", '{"name":"x"}'), BAD),
    ("tool_arguments", tool(T, {"name": "x"}), BAD),
    ("tool_arguments", tool(T, "no"), BAD),
    ("tool_arguments", {"choices": [{"message": {"tool_calls": []}}]}, BAD),
    ("tool_arguments", chat("x"), BAD),
    ("prompt_content", chat('{"name":"x"}'), GOOD),
    ("prompt_content", chat('﻿\n {"name":"x"} \n'), GOOD),
    ("prompt_content", chat('```json\n{"name":"x"}\n```'), GOOD),
    ("prompt_content", chat('```\n{"name":"x"}\n```\n'), GOOD),
    ("prompt_content", chat('Here:\n```json\n{"name":"x"}\n```'), BAD),
    ("prompt_content", chat('```{"name":"x"}```'), BAD),
    ("prompt_content", chat(""), BAD),
    ("native_block", blocks({"type": "json", "json": GOOD}), GOOD),
    ("native_block", blocks({"type": "text", "text": "a"}, {"type": "json_schema", "json": GOOD}), GOOD),
    ("native_block", blocks({"type": "output_json", "json": [1]}), [1]),
    ("native_block", blocks({"type": "text"}), BAD),
    ("native_block", blocks(), BAD),
    ("native_block", {"content": "x"}, BAD),
    ("native_block", blocks({"type": "json"}), BAD),
    ("tool_input", blocks({"type": "text"}, {"type": "tool_use", "name": T, "input": GOOD}), GOOD),
    ("tool_input", blocks({"type": "tool_use", "name": T, "input": "s"}), "s"),
    ("tool_input", blocks({"type": "tool_use", "name": "other", "input": GOOD}, {"type": "tool_use", "name": T, "input": GOOD}), BAD),
    ("tool_input", blocks({"type": "tool_use", "name": T}), BAD),
    ("tool_input", {}, BAD),
]


@pytest.mark.parametrize("kind", ["content", "tool_arguments", "prompt_content", "native_block", "tool_input"])
def test_extract(spark, kind):
    rows = [(r, e) for k, r, e in EXTRACT if k == kind]
    out = column(spark, [(json.dumps(r),) for r, _ in rows], "r string", lambda: getattr(responses, kind)(F.col("r")))
    assert [BAD if x is None else json.loads(x) for x in out] == [e for _, e in rows]
    for r, e in rows:
        if e is BAD:
            with pytest.raises(Transient):
                getattr(strategies, kind)(r)
        else:
            assert getattr(strategies, kind)(r) == e


def test_suggested_name(spark):
    rows = [('{"name":"x"}', "a", "x"), ('{"name":" x "}', "a", "x"), ("{}", "a", "a"), ('{"name":42}', "a", "a"), ('{"name":""}', "a", "a"), ('{"name":"  "}', "a", "a"), ('{"name":"x","k":1}', "a", "x"), ('["x"]', "a", "a"), ('"x"', "a", "a"), ('{"name":"x"}', "", ""), ('{"name":"%s"}' % ("n" * 80), "a", "n" * 80), (None, "a", "a")]
    assert column(spark, [r[:2] for r in rows], "r string, o string", lambda: responses.suggested_name(F.col("r"), F.col("o"))) == [r[2] for r in rows]


def test_progress(spark):
    rows = [(0, 0), (0, 10), (5, 10), (10, 10), (20, 10), (1, 3)]
    out = column(spark, rows, "d int, t int", lambda: texts.progress(F.col("d"), F.col("t")))
    assert out == [bar(*r) for r in rows]
    assert out[0] == "[" + "=" * 30 + "] 0/0 identifiers" and out[2] == "[" + "=" * 15 + ">" + "-" * 14 + "] 5/10 identifiers"
    assert column(spark, [(0,), (3,), (25,)], "t int", lambda: texts.logged_steps(F.col("t"))) == [[0], [0, 1, 2, 3], [0, 3, 6, 9, 12, 15, 18, 21, 24, 25]]


def test_prompt(spark):
    out = column(spark, [("a", "let a")], "n string, s string", lambda: texts.prompt(F.col("n"), F.col("s")))
    assert out == [texts.prompt_text("a", "let a")] and "`a`" in out[0]


def test_join_url(spark):
    out = column(spark, [("http://x/v1/",), ("http://x/v1",), ("http://x//",)], "u string", lambda: http.join_url(F.col("u"), "/messages"))
    assert out == ["http://x/v1/messages", "http://x/v1/messages", "http://x/messages"]
