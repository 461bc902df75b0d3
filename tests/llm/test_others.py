"""WARC, decontamination, toxicity, LM scores, URL filter, BPE, and the pipeline."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scopeframe.llm import bpe, common, decontaminate, neural_lm, toxicity, url_filter, vec, warc


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# words and hashes


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["ab  cd", None, "", " x", "é" * 200 + " é", "tail "]
    buf, offs = vec.flat(pa.array(texts))
    starts, ends, rows = vec.words(buf, offs, vec.WHITE)
    assert [(int(r), buf[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    words = ["a", "b", "ab", "abcdefgh", "abcdefghi", "abcdefg", "x" * 255, "x" * 256, "x" * 257, "x" * 1000, "a"]
    buf, offs = vec.flat(pa.array(words))
    h = vec.hash_spans(buf, offs[:-1], offs[1:])
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[-1]
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    places = vec.Places(keys, 8)
    assert (places(keys) == np.arange(keys.size)).all() and (places(keys + np.uint64(1)) == -1).sum() >= keys.size - 5


# warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://a.example/y", "<p>é</p>"), (3, None, None), (4, "http://b.example/ ü", ""), (5, "http://c.example", "\r\n\r\nWARC/1.1\r\n" * 20), (6, "u", "z" * 400_000), (7, "u", "<p>é</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit(1), "digest": F.lit("x"), "_n": F.lit("q")})


def test_warc(pages):
    rows = {x["page_id"]: (x["html"] or "").encode() for x in pages.collect()}
    top = {}
    for k, v in rows.items():
        top[v] = max(k, top.get(v, 0))
    index = warc.write(pages)
    got = {x["page_id"]: x for x in warc.read(index, True).collect()}
    assert set(got) == set(rows)
    for k, v in rows.items():
        first = top[v]
        assert got[k]["payload_bytes"] == len(v) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(v).digest()).decode()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if k == first else ("revisit", first))
        assert bytes(got[k]["payload"]) == (v if k == first else b"")
    files = {x["file"] for x in index.collect()}
    for f in files:
        data = gzip.open(f.removeprefix("file:").replace("//", "/"), "rb").read()
        assert data.startswith(b"WARC/1.1\r\n")
    some = warc.read(index.where("page_id in (2, 6)")).collect()
    assert sorted(x["page_id"] for x in some) == [2, 6]
    assert {x["record_type"] for x in warc.read(warc.write(pages, 100)).collect()} == {"response"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (300, 50)], 90, 1000) == [(0, 3, 0, 105), (3, 4, 300, 350)]
    assert warc.ranges([(0, 10), (10, 10), (20, 10)], 5, 20) == [(0, 2, 0, 20), (2, 3, 20, 30)]
    assert warc.ranges([]) == []


# decontamination


def contamination_brute(items, text):
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(t or ""))
    words, out = split(text), []
    for k, t in items:
        w = split(t)
        n = min(5, len(w))
        if not n or len(words) < n:
            continue
        q, have = decontaminate.question_words(t), grams(words, n)
        runs = [(i, tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
        parts = {g for i, g in runs if i < max(q, 1)}, {g for i, g in runs if i + n > q}
        if all(len(p & have) >= 0.8 * len(p) for p in parts if p):
            out.append(k)
    return sorted(out)


def test_decontamination(spark, odd, none, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(3, 90)) + rng.choice([". ", "\n"]) + text(rng.randint(1, 6))) for i in range(40)] + [(90, None), (91, ""), (92, "?"), (93, "solo")]
    docs = [(i, text(rng.randint(0, 400))) for i in range(60)]
    for i in range(60, 100):
        k, t = rng.choice(items[:40])
        w = t.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, text(rng.randint(0, 300)) + " " + " ".join(w).upper() + ", " + text(rng.randint(0, 300))))
    docs.append((100, "it is solo here"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    real = [(k, t) for k, t in items if t]
    want = {i: contamination_brute(real, t) for i, t in docs}
    assert sum(map(bool, want.values())) > 10
    matcher = decontaminate._matcher
    for size in (decontaminate.INDEX_BYTES, 2000):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        sent_before = []

        def one_at_a_time(sent):
            assert not any(os.path.exists(x._path) for x in sent_before)  # those before are destroyed
            sent_before.append(sent)
            return matcher(sent)

        monkeypatch.setattr(decontaminate, "_matcher", one_at_a_time)
        rows, items = decontaminate.contamination(df, bench)
        got = rows.select("_doc.doc_id", items.alias("x")).collect()
        assert (len(sent_before) > 1) == (size == 2000)
        assert {x["doc_id"]: x["x"] for x in got} == want
    monkeypatch.setattr(decontaminate, "_matcher", matcher)
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.drop_contaminated(none, bench).count() == 0


@pytest.mark.parametrize("dense", [4 << 20, 0])
def test_wand_retrieves_all_above_threshold(dense, monkeypatch):
    """Pruned retrieval against plain scores, with block maxima in a matrix and in sorted keys."""
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "DENSE", dense)

    rng = random.Random(7)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(n))
    texts = [text(rng.randint(1, 80)) for _ in range(50)]
    df = Counter(w for t in texts for w in set(t.split()))
    mean = sum(len(t.split()) for t in texts) / 50
    buf, offs = vec.flat(pa.array(list(df)))
    frequency = dict(zip(vec.hash_spans(buf, offs[:-1], offs[1:]).view(np.int64).tolist(), df.values(), strict=True))
    index = decontaminate.build(list(range(50)), texts, frequency, 50, mean)

    def impact(w, t):
        words = t.split()
        tf = words.count(w)
        idf = math.log1p((50 - df[w] + 0.5) / (df[w] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) if tf else 0.0

    docs = [text(rng.randint(0, 500)) for _ in range(20)] + [texts[3] + " " + text(200), text(90) + " " + texts[5]]
    got = set(zip(*(x.tolist() for x in decontaminate.retrieve(index, *decontaminate.hashed(pa.array(docs)))), strict=True))
    want = set()
    for d, t in enumerate(docs):
        words = t.split()
        n = max(0, -(-(len(words) - decontaminate.PASSAGE) // decontaminate.STRIDE)) + 1
        for p in range(n):
            query = set(words[p * decontaminate.STRIDE : p * decontaminate.STRIDE + decontaminate.PASSAGE])
            for i, item in enumerate(texts):
                own = sum(impact(w, item) for w in set(item.split()))
                if sum(impact(w, item) for w in query) >= decontaminate.SHARE * own * min(1, decontaminate.STRIDE / len(item.split())):
                    want.add((d, i))
    assert got == want


# toxicity


def test_least(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(500)], "k long, j long")
    for most in (0, 1, 100, 499, 500, 900):
        for hashed in (F.xxhash64("k"), F.xxhash64("j")):  # the second has many ties
            want = rows.orderBy(hashed, "k").limit(most).collect()
            assert sorted(common.least(rows, hashed, most, "k").collect()) == sorted(want)
    assert common.least(rows.limit(0), F.xxhash64("k"), 5, "k").count() == 0


def test_toxicity(spark, odd, none, labels):
    rng = random.Random(1)
    rows, said = [], []
    for i in range(1500):
        bad = rng.random() < 0.25
        w = [f"w{rng.randrange(900)}" for _ in range(rng.randint(5, 150))]
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["foul", "vile", "rude"]))
        rows.append((i, " ".join(w)))
        said.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = docs.select("doc_id", toxicity.scorer(spark, model)(F.col("text")).alias("s")).collect()
    held = [(x["s"] >= 0.5) == bool(said[x["doc_id"]][2]) for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.95 and len(model[0]) < 5000
    out = toxicity.drop_toxic(odd, labels)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert toxicity.drop_toxic(none, labels).count() == 0 and toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


# LM


def test_lm(spark, odd, none):
    rng = random.Random(6)
    ways = {k: [f"{k}{i}" for i in range(60)] for k in "abcd"}
    rows = []
    for i in range(400):
        k = rng.choice("abcd")
        rows.append((i, " ".join(rng.choice(ways[k]) for _ in range(rng.randint(0, 80)))))
    rows += [(1000, None), (1001, "Rare WORDS only é" + "x" * 400)]
    got = {x["doc_id"]: x for x in neural_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(t), sum(w in c for w in t), n)
        assert math.isclose(x["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    out = [got[i] for i in tokens if held[i]]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out)
    alone = neural_lm.score_documents(spark.createDataFrame([(next(i for i in held if held[i]), "two words")], "doc_id long, text string")).first()
    assert (alone["held_out"], alone["n_tokens"], alone["n_known"], alone["train_tokens"]) == (True, 3, 0, 0)
    assert neural_lm.score_documents(none).count() == 0 and neural_lm.score_documents(odd).count() == 10


def test_lm_head_bound_changes_nothing(spark, monkeypatch):
    """Counts of words beyond the broadcast head come by the join."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(60))) for i in range(60)], "doc_id long, text string")
    score = lambda: {x["doc_id"]: (x["n_known"], round(x["base_score"], 6)) for x in neural_lm.score_documents(docs).collect()}
    whole = score()
    monkeypatch.setattr(neural_lm, "HEAD", 800)
    assert score() == whole


def test_lm_trains_on_each_position_once(spark, monkeypatch):
    """Whatever batches the rounds see. Words occur once each, so that a class tells its position."""
    texts = [" ".join(f"w{i}" for i in range(a, a + 35)) for a in range(0, 700, 35)]
    h, tail, _ = neural_lm.tokens(*vec.flat(pa.array(texts)))
    words = h[h != neural_lm.END]
    places = np.argsort(words)
    vocab = neural_lm.Vocabulary(words[places], np.ones(700, np.int64), np.arange(700), np.ones(neural_lm.CLASSES), np.ones(neural_lm.CLASSES), 720, 701)
    seen, rounds = Counter(), []

    class Docs:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            k = 3 + 4 * len(rounds)
            order = texts if not rounds else texts[::-1]
            rounds.append(list(run(iter([pa.RecordBatch.from_arrays([pa.array(order[a : a + k])], ["text"]) for a in range(0, len(texts), k)]))))
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(neural_lm, "train", lambda own, noise, parts, rate: [seen.update(y.tolist()) for *_, y in parts] and 0)
    neural_lm.fit(Docs(), vocab)
    assert len(rounds) == neural_lm.ROUNDS
    assert seen == Counter({**dict.fromkeys(range(700), 1), neural_lm.TOP: len(texts)})


def test_lm_is_normalised():
    rng = np.random.default_rng(3)
    noise = rng.random(neural_lm.CLASSES)
    model = neural_lm.start(noise / noise.sum())
    s1, s2, z = model.tables()
    for two, one in ((0, 5), (7, 7), (neural_lm.TOP, 1000)):
        assert math.isclose((10.0 ** (s1[one] + s2[two] - z[two, one]).astype(float)).sum(), 1, rel_tol=1e-3)


# URLs


def judged(rows, spark):
    return {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}


def test_urls(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.Example.COM/en/x?q#z"), (3, "https://www.example.com/en/a"), (4, "x://example.com/en"), (5, "http://b.net/es/"), (6, "http://net/fr/1"), (7, "http://b.net/de/"), (8, "http://b.com"), (9, "http://b.com?x=/y"), (10, "http://telecom/"), (11, "a://b://c/d"), (12, "http://h.org/" + "p/" * 5000), (7, "http://b.net/de/")]
    got = judged(rows, spark)
    want = {0: ("", "", None), 1: ("", "", None), 2: ("a.example.com", "/en/x", "example.com/en/"), 3: ("www.example.com", "/en/a", "www.example.com/en/"), 4: ("example.com", "/en", "com/"), 5: ("b.net", "/es/", "net/es/"), 6: ("net", "/fr/1", "net/fr/"), 7: ("b.net", "/de/", None), 8: ("b.com", "", None), 9: ("b.com", "", None), 10: ("telecom", "/", None), 11: ("b:", "//c/d", None)}
    for k, v in want.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == v
    assert {got[k]["verdict"] for k in (2, 5, 6)} == {"block"} and {got[k]["verdict"] for k in (3, 4)} == {"allow"}
    assert all(x["verdict"] in ("allow", "block") for x in got.values())
    assert judged([], spark) == {}
    assert {x["verdict"] for x in judged([(1, "http://a.org/x")], spark).values()} == {"allow"}


def test_trees_learn(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(9)}.example.com/{'en' if i % 2 else 'de'}/" + "9" * (20 if i % 2 else 1)) for i in range(600)]
    rows += [(1000, "http://h.org/en/" + "9" * 20), (1001, "http://h.org/de/9")]
    got = judged(rows, spark)
    assert got[1000]["score"] > got[1001]["score"] and got[1001]["verdict"] == "allow"


# BPE


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def other():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(codec, other):
    rng = random.Random(1)
    texts = ["", " ", "a" * 3000, "ab" * 1500, "日本語 テキスト", "\n\n\t x", "'s 'll don't", "<|endoftext|>", "\u200d👩‍🚀" * 50]
    texts += ["".join(rng.choices("ab cé\n's1日.,", k=rng.randint(0, 300))) for _ in range(150)]
    texts += ["".join(rng.choices("abcdethrning", k=rng.randint(1, 500))) for _ in range(100)]
    for many in (texts, texts[::-1]):
        for text, ids in zip(many, codec.encode_many(many), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
            assert codec.decode(ids).decode() == text


def test_bpe_memory_is_emptied(codec, other, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for text in ("some words here", "quite other words there", "some words here"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_rank_queue():
    rng = random.Random(2)
    queue, plain = bpe.RankQueue(70_000), []
    for _ in range(3000):
        if plain and rng.random() < 0.45:
            plain.sort()
            assert queue.pop() == plain.pop(0)
        else:
            x = rng.randrange(70_000) if rng.random() < 0.8 else 5, rng.randrange(1000)
            plain.append(x)
            queue.push(*x)
    for x in sorted(plain):
        assert queue.pop() == x
    assert queue.pop() is None


def test_bpe_rows(odd, none, other):
    for x in bpe.production(odd, True).collect():
        assert x["n_tokens"] == len(x["ids"])
    want = Counter((x["doc_id"], len(i := other.encode_ordinary(x["text"] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((x["text"] or "").encode()).hexdigest()) for x in odd.collect())
    assert Counter(map(tuple, bpe.production(odd).collect())) == want
    assert bpe.production(none).count() == 0


# all


def test_registry_and_pipeline(spark, tmp_path, odd, labels):
    import corpus_pipeline
    from scopeframe.llm import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "bpe"]
    item = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu"
    more = spark.createDataFrame([(20, "Some words before " + item + " and after"), (22, "clean text of its own with words")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(x["doc_id"] for x in out.collect()) == Counter([1, 3, 3, 5, 6, 22, None])
    common.release(spark)
