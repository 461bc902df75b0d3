import io
import threading

import pytest
from pyspark.sql import functions as F

from scopeframe import cli
from scopeframe.observe import Observer
from scopeframe.operators import suggest
from scopeframe.plans.rename import rename
from scopeframe.providers import ladder as ladder_module
from scopeframe.providers import strategies
from scopeframe.providers.http import HttpClient, NotSupported, Transient
from scopeframe.providers.judge import SCHEMA as JUDGE_SCHEMA
from scopeframe.providers.judge import judge
from scopeframe.providers.ladder import Ladder
from scopeframe.providers.naming import name_for
from scopeframe.providers.presets import CHAT, MESSAGES, PRESETS, JsonMode, Settings, mode_error
from scopeframe.sources import read_files, read_text, write_files
from scopeframe.streaming import watch


class Scripted:
    def __init__(self, name, *answers):
        self.name, self.answers, self.calls = name, list(answers), 0

    def call(self, system, user, schema):
        self.calls += 1
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if answer == "no":
            raise NotSupported("no")
        if answer == "later":
            raise Transient("later")
        return answer


def run(ladder, times=1):
    out = []
    for _ in range(times):
        try:
            out.append(ladder.call("s", "u", {}))
        except Transient:
            out.append("later")
    return out


LADDERS = [
    # answers by strategy, pinned, calls, results, locked, counts
    ([[1]], False, 2, [1, 1], 0, [2]),
    ([["no"], [2]], False, 2, [2, 2], 1, [1, 2]),
    ([["later"], [2]], False, 1, ["later"], None, [1, 0]),
    ([["no"], ["no"]], False, 2, ["later", "later"], None, [1, 1]),
    ([[1, "no"], [2]], False, 2, [1, 2], 1, [2, 1]),
    ([[1, "later", 1], [2]], False, 3, [1, "later", 1], 0, [3, 0]),
    ([["no"]], True, 2, ["later", "later"], 0, [2]),
    ([[1, "no"]], False, 2, [1, "later"], 0, [2]),
    ([["no"], [2, "no"], [3]], False, 3, [2, 3, 3], 2, [1, 2, 2]),
]


@pytest.mark.parametrize("case", LADDERS)
def test_ladder(case):
    answers, pinned, calls, results, locked, counts = case
    s = [Scripted(str(i), *a) for i, a in enumerate(answers)]
    made = Ladder(s, pinned)
    assert run(made, calls) == results
    assert made.locked == locked and [x.calls for x in s] == counts


def test_ladder_size():
    for n in (0, 65):
        with pytest.raises(ValueError):
            Ladder([Scripted("x", 1)] * n)


def test_ladder_from_many_threads():
    s = [Scripted("a", "no"), Scripted("b", 2)]
    made, out = Ladder(s), []
    threads = [threading.Thread(target=lambda: out.extend(run(made))) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out == [2] * 8 and made.locked_name == "b"


def test_trace_equals_ladder(spark):
    import random

    rng = random.Random(1)
    kinds = {"ok": "ok", "not_supported": "no", "transient": "later"}
    for n in (1, 2, 3):
        logs = [[[rng.choice(list(kinds)) for _ in range(n)] for _ in range(rng.randint(0, 8))] for _ in range(30)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, calls array<array<string>>")
        got = {x["i"]: x["t"] for x in df.select("i", ladder_module.trace(F.col("calls"), n).alias("t")).collect()}
        for i, log in enumerate(logs):
            now = [Scripted(str(k), "") for k in range(n)]
            made, want = Ladder(now), []
            for answers in log:
                for s, a in zip(now, answers, strict=True):
                    s.answers = [kinds[a]]
                result = run(made)[0]
                want.append((-1 if made.locked is None else made.locked, sum(1 << d for d in made.dead), -1 if result == "later" else made.locked))
            assert [(x["locked"], x["dead"], x["result"]) for x in got[i]] == want


class Recorder(HttpClient):
    def __init__(self, reply):
        super().__init__()
        self.reply = reply

    def post_json(self, url, key, headers, body):
        self.sent = url, key, headers, body
        return self.reply


@pytest.mark.parametrize("kind", [strategies.JsonSchema, strategies.ForcedTool, strategies.NudgedTool, strategies.PromptedJson])
def test_chat_requests(kind):
    reply = {"choices": [{"message": {"content": '{"name":"x"}', "tool_calls": [{"function": {"name": strategies.TOOL, "arguments": '{"name":"x"}'}}]}}]}
    client = Recorder(reply)
    assert kind(client, "http://h/v1/", "key", "m").call("sys", "user", {"type": "object"}) == {"name": "x"}
    url, key, headers, body = client.sent
    assert url == "http://h/v1/chat/completions" and key == "key" and headers == {} and body["model"] == "m"
    assert ("response_format" in body) == (kind is strategies.JsonSchema)
    assert ("tools" in body) == issubclass(kind, strategies.ForcedTool)
    assert (body["messages"][0]["content"] == "sys") == (kind in (strategies.JsonSchema, strategies.ForcedTool))


@pytest.mark.parametrize("kind", [strategies.MessagesNative, strategies.MessagesTool])
def test_messages_requests(kind):
    client = Recorder({"content": [{"type": "json", "json": {"name": "x"}}, {"type": "tool_use", "name": strategies.TOOL, "input": {"name": "x"}}]})
    assert kind(client, "http://h", "key", "m").call("sys", "user", {}) == {"name": "x"}
    url, key, headers, body = client.sent
    assert url == "http://h/messages" and key is None and headers["x-api-key"] == "key" and body["max_tokens"] == 4096
    assert ("anthropic-beta" in headers) == (kind is strategies.MessagesNative) == ("output_format" in body)


@pytest.mark.parametrize("answer, name", [({"name": " x "}, "x"), ({}, "a"), ({"name": 42}, "a"), ({"name": " "}, "a"), (["x"], "a"), ("x", "a"), ("later", "a")])
def test_name_for(answer, name):
    assert name_for(Ladder([Scripted("s", answer)], True), "a", "code")[0] == name


def test_empty_name_asks_nothing():
    s = Scripted("s", {"name": "x"})
    assert name_for(Ladder([s]), "", "code")[0] == "" and s.calls == 0


def test_model_renamer(spark):
    def make():
        class Upper:
            name = "upper"

            def call(self, system, user, schema):
                return {"name": "named"}

        return Ladder([Upper()])

    sources = spark.createDataFrame([("1", "let a = 1"), ("2", "let a = 1"), ("3", "let b = a")], "source_id string, code string")
    done = rename(sources, suggest.ModelRenamer(make, parallel=2))
    out = {x["source_id"]: x["output"] for x in done.output.collect()}
    assert out == {"1": "let named = 1", "2": "let named = 1", "3": "let named = a"}
    assert {x["strategy"] for x in done.suggestions.collect()} == {"upper"}


def test_judge():
    waits = []
    assert judge(Scripted("s", "later", "later", {"verdict": "GOOD"}), "x", waits.append) == "GOOD" and waits == [5, 15]
    with pytest.raises(Transient):
        judge(Scripted("s", "later"), "x", waits.append)
    assert waits[2:] == [5, 15, 30, 60] and JUDGE_SCHEMA["required"] == ["verdict"]


def test_modes():
    assert JsonMode.parse("ladder") is JsonMode.LADDER
    with pytest.raises(ValueError):
        JsonMode.parse("Ladder")
    for mode in JsonMode:
        assert (mode_error(mode, CHAT) is None) == (mode is not JsonMode.NATIVE)
        assert (mode_error(mode, MESSAGES) is None) == (mode in (JsonMode.NATIVE, JsonMode.LADDER))


def test_settings(monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "from-env")
    s = Settings.of(PRESETS["openai"], model="m")
    assert (s.model, s.key, s.context_size, s.timeout) == ("m", "from-env", 500, 60)
    assert Settings.of(PRESETS["openai"], api_key="k").key == "k"
    monkeypatch.setenv("OPENAI_API_KEY", "")
    assert Settings.of(PRESETS["openai"]).key is None
    assert [x.name for x in s.ladder().strategies] == ["openai-json-schema", "forced-tool-call", "prompt"]
    assert Settings.of(PRESETS["openai"], json_mode="prompt").ladder().locked_name == "prompt"
    assert [x.name for x in Settings.of(PRESETS["anthropic"]).ladder().strategies] == ["anthropic-tool-call-and-prompt"]
    assert PRESETS["ollama"].timeout == 1800 and not PRESETS["ollama"].key_variable
    assert "from-env" not in "\n".join(s.report("in", None))


def test_observer_logs_every_tenth():
    out = io.StringIO()
    seen = Observer(False, True, stream=out)
    seen.found(100)
    for i in range(1, 101):
        seen.finished(i, 100, "a", "b")
    assert len(out.getvalue().splitlines()) == 11


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.js").write_bytes("let a = 'é'\n".encode())
    rows = read_files(spark, str(tmp_path / "in")).collect()
    assert [x["code"] for x in rows] == ["let a = 'é'\n"]
    (tmp_path / "in/b.js").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF-8"):
        read_files(spark, str(tmp_path / "in")).collect()
    with pytest.raises(UnicodeDecodeError):
        read_text(spark, str(tmp_path / "in/b.js"))
    with pytest.raises(FileNotFoundError):
        read_text(spark, str(tmp_path / "none.js"))
    df = spark.createDataFrame([("x/a.js", "let b")], "source_id string, output string")
    assert write_files(df, str(tmp_path / "out")).collect()[0]["n_bytes"] == 5
    assert (tmp_path / "out/a.js").read_bytes() == b"let b"


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.js").write_text("let a = 1")
    go = lambda: watch(spark, str(tmp_path / "in"), suggest.fixed("b"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    (tmp_path / "in/b.js").write_text("let c = 1")
    go()
    assert [x["output"] for x in spark.read.parquet(str(tmp_path / "out")).collect()] == ["let b = 1", "let b = 1"]


def offline(*more):
    return ["openai", *more, "--base-url", "http://127.0.0.1:1", "--api-key", "must-not-be-printed"]


def test_cli_offline(spark, tmp_path, capsys):
    (tmp_path / "a.js").write_text("const x = 1;")
    out = tmp_path / "o.js"
    assert cli.main(offline(str(tmp_path / "a.js"), "-o", str(out), "--context-size", "321", "--verbose", "--progress")) == 0
    assert out.read_text() == "const x = 1;"
    said = capsys.readouterr().err
    for x in ("* provider: openai", "* model: gpt-5-mini (default)", "* base URL: http://127.0.0.1:1 (command line)", "* API key: set (command line)", "* context size: 321 (command line)", "* found 1 identifiers", "* [1/1] renaming `x`", "* [1/1] `x` -> `x`"):
        assert x in said
    assert "must-not-be-printed" not in said


def test_cli_codes(spark, tmp_path, capsys):
    (tmp_path / "bad.js").write_text("const = 1")
    assert cli.main(offline(str(tmp_path / "bad.js"), "-o", str(tmp_path / "o.js"))) == 2 and not (tmp_path / "o.js").exists()
    assert cli.main(offline(str(tmp_path / "none.js"))) == 1
    assert cli.main(offline(str(tmp_path / "bad.js"), "--json-mode", "anthropic-native")) == 64
    assert cli.main(offline(str(tmp_path / "bad.js"), "--json-mode", "x")) == 64
    for argv, code in ((["nothing"], 64), (["--version"], 0), ([], 64)):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        assert e.value.code == code


def test_files_keep_their_paths_below_the_root(spark, tmp_path):
    rows = [("/in/a/x.js", "one"), ("/in/b/x.js", "two")]
    df = spark.createDataFrame(rows, "source_id string, output string")
    assert write_files(df, str(tmp_path / "out"), root="/in").count() == 2
    assert ((tmp_path / "out/a/x.js").read_text(), (tmp_path / "out/b/x.js").read_text()) == ("one", "two")
    for bad in ("/elsewhere/x.js", None):
        with pytest.raises(Exception, match="below|without a name"):
            write_files(spark.createDataFrame([(bad, "t")], "source_id string, output string"), str(tmp_path / "out"), root="/in").collect()
