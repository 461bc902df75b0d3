"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scopeframe.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, x) for i, x in enumerate(texts)], "doc_id long, text string")


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# exact


def test_chunk_hashes_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 10_000, np.uint8)
    tables = [exact_dedup.powers(b, p, 20_000) for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True)]
    whole = exact_dedup.chunk_terms(data, np.array([0, data.size]), np.array([0]), tables)
    for cuts in ([0, 10_000], [0, 1, 5000, 10_000], [0, 3333, 3333, 9999, 10_000]):
        cuts = np.array(cuts)
        parts = exact_dedup.chunk_terms(data, cuts, data.size - cuts[1:], tables)
        for k in (0, 1):
            assert parts[k].sum() % exact_dedup.PRIMES[k] == whole[k][0]
    want = 0
    for b in data[:50]:
        want = (want * exact_dedup.BASES[0] + int(b) + 1) % exact_dedup.PRIMES[0]
    assert exact_dedup.chunk_terms(data[:50], np.array([0, 50]), np.array([0]), tables)[0][0] == want


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_exact(spark, odd, chunk, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    docs = odd.where("length(text) < 1000 or text is null") if chunk == 7 else odd
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    got = exact_dedup.exact_groups(docs).drop("_row_kept")
    assert Counter(map(tuple, got.collect())) == exact_brute(rows)


def test_exact_tells_collisions_apart(spark, monkeypatch):
    """With a fingerprint that is always the same, the chunkwise comparison and SHA-256 still part the texts."""
    monkeypatch.setattr(exact_dedup, "PRIMES", (1, 1))
    rows = [(0, "ab"), (1, "cd"), (2, "ab"), (3, "c d")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("_row_kept")
    assert Counter(map(tuple, got.collect())) == exact_brute(rows)


def test_exact_stage(odd, none):
    out = exact_dedup.keep_first(odd)
    assert out.columns == odd.columns
    assert Counter(x["doc_id"] for x in out.collect()) == Counter([1, 3, 3, 4, 5, 6, None])
    assert exact_dedup.keep_first(none).count() == 0 == exact_dedup.exact_groups(none).count()


# near


def shingle_set(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_brute(rows):
    big = 1 << 62
    sets = [(big if i is None else i, shingle_set(t)) for i, t in rows]
    least = {}
    for i, s in sets:
        least[s] = min(i, least.get(s, big))
    size, reps = Counter(s for _, s in sets), list(least)
    links, root = Counter(), {least[s]: least[s] for s in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(reps)):
        for b in range(a):
            x, y = reps[a], reps[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[x] += 1
                links[y] += 1
                p, q = sorted((find(least[x]), find(least[y])))
                root[q] = p
    un = lambda x: None if x == big else x
    return Counter((un(i), un(least[s]), size[s], links[s], un(find(least[s]))) for i, s in sets)


def near_texts(rng, families, each):
    out = []
    for _ in range(families):
        base = words_of(rng, rng.randint(20, 120), 5000)
        for _ in range(each):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = "changed"
            out.append(" ".join(x))
    out += [" ".join(words_of(rng, rng.randint(0, 40))) for _ in range(30)]
    return out


def test_near(spark, odd, none):
    rng = random.Random(3)
    docs = frame(spark, near_texts(rng, 6, 8), 100).unionByName(odd.select("doc_id", "text"))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == near_brute(rows)
    assert ngram_join.near_duplicates(none).count() == 0


def test_near_blocks_lose_no_link(spark, monkeypatch):
    """One family, cut into many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 7)
    docs = frame(spark, near_texts(random.Random(5), 1, 60))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == near_brute(rows)


def test_bands_reach_recall():
    for s, r in ((0.8, 6), (0.9, 8), (0.7, 4)):
        b = ngram_join.bands_for(s, r, 0.999)
        assert 1 - (1 - s**r) ** b >= 0.999 > 1 - (1 - s**r) ** (b - 1)


def test_near_stage(odd, none):
    out = ngram_join.keep_one(odd)
    assert out.columns == odd.columns and Counter(x["doc_id"] for x in out.collect()) == Counter([1, 3, 3, 5, 6, None])
    assert ngram_join.keep_one(none).count() == 0


#: Different texts without an id and under one id, a repeated row, and near copies without an id, of each other and of an id.
APART = [(None, "a b c d e f"), (None, "g h i j k l"), (7, "m n o p q r"), (7, "s t u v w x"), (8, "same row"), (8, "same row")]
NEAR = [(None, " ".join(f"y{i}" for i in range(40))), (None, " ".join(f"y{i}" for i in range(41))), (9, " ".join(f"z{i}" for i in range(40))), (None, " ".join(f"z{i}" for i in range(41)))]


def test_stages_keep_rows_without_ids_of_their_own(spark):
    docs = spark.createDataFrame(APART + NEAR, "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.keep_first(docs).collect())) == Counter(set(APART + NEAR))
    out = Counter(map(tuple, ngram_join.keep_one(docs).collect()))
    assert sum(out[x] for x in NEAR[:2]) == 1
    assert Counter({x: n for x, n in out.items() if x not in NEAR[:2]}) == Counter({*APART, NEAR[2]})


def test_near_without_ids(spark):
    """No group or link but the right ones, and near copies without ids are linked."""
    docs = spark.createDataFrame(APART + NEAR, "doc_id long, text string")
    got = Counter(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == Counter({(None, None, 1, 0, None): 2, (7, 7, 1, 0, 7): 2, (8, 8, 2, 0, 8): 2, (None, None, 1, 1, None): 2, (9, 9, 1, 1, 9): 1, (None, None, 1, 1, 9): 1})


# lines


def within(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    last = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        now = [i]
        for j in range(1, len(b) + 1):
            now.append(min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, now[-1] + 1))
        last = now
    return last[-1] <= k


def line_brute(rows, edits, least):
    """rows: (id, text, place of the text among those of its id); of repeated rows the first has the first lines."""
    first, order = {}, []
    keyed = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    for at, (_, t, _) in enumerate(keyed):
        for n, x in enumerate((t or "").encode().split(b"\n")):
            if x not in first:
                first[x] = (at, n)
                order.append(x)
    near = {y for k, y in enumerate(order) if len(y) >= least and any(len(x) >= least and within(x, y, edits) for x in order[:k])}
    out = []
    for at, (i, t, _) in enumerate(keyed):
        fates = [("near" if x in near else "kept") if first[x] == (at, n) else "copy" for n, x in enumerate((t or "").encode().split(b"\n"))]
        out.append((i, len(fates), fates.count("kept"), fates.count("copy"), fates.count("near"), tuple(n for n, f in enumerate(fates) if f != "kept")))
    return Counter(out)


def line_check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    placed = docs.select("doc_id", "text", line_dedup.common.row_key(docs, F.col("doc_id"), text)).collect()
    got = Counter((*tuple(x)[:5], tuple(x["dropped"])) for x in line_dedup.dedup(docs).collect())
    assert got == line_brute([tuple(x) for x in placed], 2, 24)
    return got


def mutated(rng, line, edits):
    x = list(line)
    for _ in range(edits):
        at, what = rng.randrange(len(x)), rng.randrange(3)
        if what == 0:
            x[at] = rng.choice("abcé")
        elif what == 1:
            x.insert(at, rng.choice("abcé"))
        else:
            del x[at]
    return "".join(x)


@pytest.mark.parametrize("hot, block", [(48, 64), (2, 3)])
def test_lines(spark, hot, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup.later_lines, "__defaults__", (2, 24, hot))
    rng = random.Random(9)
    bases = ["".join(rng.choices("abcdefgh é", k=rng.randint(22, 60))) for _ in range(12)]
    # lines that share a beginning but aren't near, so that a key's earliest line settles few
    bases += ["the very same beginning " + "".join(rng.choices("abcdefgh ", k=rng.randint(16, 24))) for _ in range(6)]
    lines = [mutated(rng, rng.choice(bases), rng.randint(0, 4)) for _ in range(120)] + ["", "short", "short"]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(24)] + [(90, None), (91, "")]
    rest = ["\n".join(lines[96 + i * 3 : 99 + i * 3]) for i in range(8)]
    rows += [(None, rest[0]), (None, rest[1]), (5, rest[2]), (5, rest[3]), (6, rows[6][1]), (None, rest[0]), (95, rest[0]), (96, "\n".join(rest[4:]))]
    line_check(spark, rows)


def test_lines_of_a_family(spark, monkeypatch):
    """One line in many variants: rows of intermediate tables follow the lines, not their pairs."""
    monkeypatch.setattr(line_dedup.later_lines, "__defaults__", (2, 24, 8))
    made = []
    write = line_dedup.common.materialise
    monkeypatch.setattr(line_dedup.common, "materialise", lambda df, tag, *more: made.append((tag, out := write(df, tag, *more))) or out)
    rng = random.Random(4)
    base = "a line of some length that many documents hold in variants"
    rows = [(i, mutated(rng, base, 1)) for i in range(150)]
    got = line_check(spark, rows)
    assert sum(n for x, n in got.items() if x[2]) < 20
    assert {tag: df.count() for tag, df in made}.get("unsettled-lines", 0) < 150 * 12


@pytest.mark.parametrize("hot", [48, 8])
def test_lines_that_share_a_passage(spark, hot, monkeypatch):
    """Lines that hold the same passage and differ otherwise: neither rows nor what is held against one another inside rows
    follow their pairs, and none of the near lines among them is lost."""
    monkeypatch.setattr(line_dedup.later_lines, "__defaults__", (2, 24, hot))
    made = {}
    write = line_dedup.common.materialise
    monkeypatch.setattr(line_dedup.common, "materialise", lambda df, tag, *more: made.setdefault(tag, write(df, tag, *more)))
    rng = random.Random(6)
    # of equal length, so that the index has 40 lines a key: under one limit, over the other
    lines = ["a passage that is in all of these lines " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=40)) for _ in range(40)]
    lines += [mutated(rng, x, 2) for x in lines[:10]]
    got = line_check(spark, list(enumerate(lines)))
    assert sum(x[4] * n for x, n in got.items()) >= 8
    assert made["line-candidates"].count() < 100
    if hot == 8:
        left, right = made["blocks-left"].select("k", "q", F.size("xs").alias("u")), made["blocks-right"].select("k", "q", F.size("ys").alias("n"))
        pairs = left.join(right, ["k", "q"]).agg(F.sum(F.col("u") * F.col("n"))).first()[0]
        assert pairs < 50 * 50 // 4


def test_near_lines_are_alike(spark):
    """No near pair is ruled out by letters, and most others are."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdeXYé日İ ", k=n))
    lines = [word(rng.randint(24, 40)) for _ in range(150)]
    pairs = [(x, mutated(rng, x, rng.randint(0, 3))) for x in lines] + list(zip(lines[1:], lines[:-1], strict=True))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *(line_dedup.marked(F.col(x).cast("binary")).alias(f"x{x}") for x in "ab"))
    got = rows.select("a", "b", line_dedup.alike(F.col("xa"), F.col("xb"), 2).alias("ok")).collect()
    assert all(x["ok"] for x in got if within(x["a"].encode(), x["b"].encode(), 2))
    assert sum(x["ok"] for x in got) < 200


def test_lines_odd(odd, none):
    got = line_dedup.dedup(odd).collect()
    assert len(got) == 10 and sum(x["n_kept"] for x in got) == 7
    assert line_dedup.dedup(none).count() == 0


# substrings


def substring_brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    out = []
    for i, t in data:
        cover = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def test_suffix_arrays():
    rng = random.Random(3)
    for trial in range(40):
        base = [bytes(rng.choices(b"abc", k=rng.randint(1, 400))) for _ in range(4)]
        texts = [b"".join(rng.choices(base, k=rng.randint(0, 3))) + bytes(rng.choices(b"ab", k=rng.randint(0, 50))) for _ in range(8)]
        if trial % 5 == 0:
            texts.append(b"a" * rng.randint(0, 700))
        seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        want = [[seen[t[i : i + 200]] > 1 for i in range(max(0, len(t) - 199))] for t in texts]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(texts)] == want


def test_suffix_order_is_sorted():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 500))) for _ in range(6)]
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    order, _ = suffix_dedup.suffix_order(buf, ends - sizes, ends, 512)
    owner = np.repeat(np.arange(6), sizes)
    suffix = lambda i: [*buf[i : ends[owner[i]]], 256 + owner[i]]
    assert order.tolist() == sorted(range(buf.size), key=suffix)


@pytest.mark.parametrize("contexts, merge", [(2048, 500_000), (2, 50)])
def test_substrings(spark, contexts, merge, monkeypatch):
    """Small bounds send shared passages through several shards and the merge."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", merge)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghij é\n", k=n))
    passages = [text(n) for n in (150, 199, 205, 260, 700)]
    rows = [(i, text(rng.randint(0, 300)) + rng.choice(passages) + text(rng.randint(0, 60)) + rng.choice(passages)) for i in range(30)]
    rows += [(50, None), (51, ""), (52, "z" * 1000), (53, "z" * 250), (54, passages[4]), (55, passages[4])]
    # without ids, with a repeated id, and a repeated row
    rows += [(None, text(220) + passages[3]), (None, text(500)), (7, passages[2] + text(300)), (7, text(240)), (54, passages[4])]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == substring_brute(rows)


def test_window_hashes_tell_windows():
    rng = random.Random(4)
    data = bytes(rng.choices(b"ab", k=500)) * 2
    buf = np.frombuffer(data, np.uint8)
    for length in (8, 24, 100, 200):
        got = [suffix_dedup.window_hashes(buf, s, length) for s in (1, 2)]
        want = [data[i : i + length] for i in range(len(data) - length + 1)]
        for d in got:
            assert d.size == len(want) and len(set(zip(d.tolist(), want, strict=True))) == len(set(want)) == len(set(d.tolist()))
    assert suffix_dedup.window_hashes(buf[:100], 1).size == 0


def test_merged_runs():
    """Runs of digests that often share their first half, against a count."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        runs, seen = [], Counter()
        for _ in range(rng.integers(1, 7)):
            keys = sorted({(int(a), int(b)) for a, b in rng.integers(0, 6, (rng.integers(1, 20), 2))})
            more = rng.integers(0, 5, len(keys)) == 0
            runs.append((np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64), more.astype(np.uint8)))
            for k, m in zip(keys, more, strict=True):
                seen[k] += 1 + int(m)
        table = pa.table({"shard": pa.array(range(len(runs)), pa.int32()), **{c: pa.array([r[i].tobytes() for r in runs], pa.binary()) for i, c in enumerate(("d1", "d2", "more"))}})
        got = suffix_dedup._merge(table)
        for r, d1, d2 in zip(runs, got["d1"].to_pylist(), got["d2"].to_pylist(), strict=True):
            want = [k for k in zip(r[0].tolist(), r[1].tolist(), strict=True) if seen[k] > 1]
            assert list(zip(np.frombuffer(d1, np.uint64).tolist(), np.frombuffer(d2, np.uint64).tolist(), strict=True)) == want


def test_no_row_a_window(spark, monkeypatch):
    """A passage that many different contexts share is a run a shard: rows follow shards, not contexts."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 40)
    made = []
    write = suffix_dedup.common.materialise
    monkeypatch.setattr(suffix_dedup.common, "materialise", lambda df, tag: made.append((tag, out := write(df, tag))) or out)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage = word(260)
    rows = [(i, word(80) + passage + word(80)) for i in range(400)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["n_removed"] for x in got} <= set(range(260, 270))
    sizes = {tag: df.count() for tag, df in made}
    assert 0 < sizes["window-runs"] <= 100 < sizes["contexts"]


def test_substrings_odd(odd, none):
    rows = [(x["doc_id"], x["text"]) for x in odd.collect()]
    assert Counter(map(tuple, suffix_dedup.dedup(odd).collect())) == substring_brute(rows)
    assert suffix_dedup.dedup(none).count() == 0


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "q" + "ab" * 150), (2, "ab" * 150 + "r")], "doc_id long, text string")
    assert {x["doc_id"]: x["kept"] for x in suffix_dedup.dedup(docs, True).collect()} == {1: b"q", 2: b"r"}
    assert docs.select(F.max("doc_id")).first()[0] == 2
