"""LM scoring by a log-bilinear model, trained in numpy with noise-contrastive estimation.

A text's tokens are its words and one end. The most frequent words are classes of their own, and others fall into classes by
their last bytes. The model gives a class from the two classes before it: q = r[a] C1 + r[b] C2, logit = q r'[c] + bias[c];
a word's share of its class comes from smoothed counts. Noise-contrastive estimation trains it without normalising; for scoring,
batched matrix products give each context's normaliser, so that token probabilities sum to one.

1. Counts of all training tokens (by 64-bit hash) are summed up before and after one shuffle.
2. Rounds of parameter mixing: each task trains on its own documents from the same start, and the parameters are averaged
   by tokens. The rounds part all texts, so that each position is trained on in one round. A task sends CLASSES * SIZE numbers, however
   much it reads.
3. Scoring is one scan with the HEAD most frequent words' counts broadcast (a bounded table). Other words go through a join
   with the full counts. No word is dropped.

Defined results: null and empty texts have one token, the end; a null id is in training; without training documents counts are
nought, and the score is that of one class; repeated rows count as often as they occur; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

END = np.uint64(0x5D3C1A7F00E1D2B9)
HEAD, TOP, TAILS, SIZE = 1 << 17, 767, 256, 24
CLASSES = TOP + 1 + TAILS
#: Rounds, tokens a step, noise samples a step, learning rate.
ROUNDS, BATCH, NOISE, RATE = 2, 512, 96, 0.1
#: Distinct words that a counting task holds at once.
HELD = 200_000
TRUE = np.ones(1, bool)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, tail class and row of each token, each row's end after its words."""
    low = vec.LOWER[buf]
    starts, ends, rows = vec.words(low, offs, vec.WHITE)
    h = vec.hash_spans(low, starts, ends)
    padded = np.concatenate([low, np.zeros(1, np.uint8)])
    two = np.where(ends - starts > 1, padded[ends - 2].astype(np.int64), 0) * 256 + padded[ends - 1] if h.size else np.zeros(0, np.int64)
    tail = (two * 2654435761 >> 7) % TAILS
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    at = np.cumsum(count)
    return np.insert(h, at, END), np.insert(tail, at, 0), np.repeat(np.arange(n), count + 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        buf, offs = vec.flat(batch.column("text"))
        for a, b in vec.slices(offs, 1 << 19):
            yield batch.slice(a, b - a), *tokens(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def summed(h: np.ndarray, tail: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[at], tail[order][at], np.add.reduceat(count[order], at)


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, tail, c of all distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give():
            h, t, c = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(c)], ["h", "tail", "c"])

        held, size = [], 0
        for _, h, tail, _ in pieces(batches):
            held.append(summed(h, tail, np.ones(h.size, np.int64)))
            size += held[-1][0].size
            if size > 2 * HELD:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = held[0][0].size
                if size > HELD:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    rows = docs.mapInArrow(common.tidy(run), "h long, tail int, c long")
    return common.materialise(rows.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")), "token-counts")


@dataclass
class Vocabulary:
    """The most frequent words: hashes, counts and classes; of each class, tokens and distinct tokens; all tokens and all
    distinct ones."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def inner(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; a word of a class of its own has all of it."""
        share = (count + 0.5) / (self.class_tokens[cls] + 0.5 * (self.class_words[cls] + 1))
        return np.where(cls <= TOP, 0.0, np.log10(np.maximum(share, 1e-300)))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def head_count(counts: DataFrame) -> int:
    """The least count such that at most HEAD words occur as often. Counts are binned, so that few numbers reach the driver;
    a bin is taken whole or not at all."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    total, least = 0, 1 << 62
    for x in sorted(bins, key=lambda x: -x["b"]):
        total += x["n"]
        if total > HEAD:
            break
        least = x["least"]
    return least


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The end is class TOP, other frequent words are classes 0 ... TOP - 1, tails follow."""
    head = counts.where((F.col("c") >= head_count(counts)) | (F.col("h") == int(END.view(np.int64)))).toPandas().sort_values(["c", "h"], ascending=[False, True])
    h, c, tail = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), head["tail"].to_numpy(np.int64)
    cls = TOP + 1 + tail
    words = np.flatnonzero(h != END)[:TOP]
    cls[words] = np.arange(words.size)
    cls[h == END] = TOP
    by_tail = {x["tail"]: (x["n"], x["v"]) for x in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens_, words_ = np.zeros(CLASSES), np.zeros(CLASSES)
    for t, (n, v) in by_tail.items():
        tokens_[TOP + 1 + t], words_[TOP + 1 + t] = n, v
    own = cls <= TOP
    np.subtract.at(tokens_, TOP + 1 + tail[own], c[own])
    np.subtract.at(words_, TOP + 1 + tail[own], 1)
    tokens_[cls[own]], words_[cls[own]] = c[own], 1
    return Vocabulary(h, c, cls, tokens_, words_, int(sum(n for n, _ in by_tail.values())), int(sum(v for _, v in by_tail.values())))


@dataclass
class Model:
    r: np.ndarray  # context vectors
    out: np.ndarray  # target vectors
    c1: np.ndarray
    c2: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.out, self.c1, self.c2, self.bias)])

    @staticmethod
    def of(x: np.ndarray) -> Model:
        parts, at = [], 0
        for shape in ((CLASSES, SIZE), (CLASSES, SIZE), (SIZE, SIZE), (SIZE, SIZE), (CLASSES,)):
            n = int(np.prod(shape))
            parts.append(x[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return Model(*parts)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 score parts of (class before, class), (class two before, class) and each context's log10 normaliser."""
        a, b = self.r @ self.c1, self.r @ self.c2
        s1, s2 = a @ self.out.T + self.bias, b @ self.out.T
        z = np.empty((CLASSES, CLASSES), np.float32)  # [two before, before]
        for k in range(CLASSES):
            logits = s1 + s2[k]
            top = logits.max(1, keepdims=True)
            z[k] = np.log(np.exp(logits - top).sum(1)) + top[:, 0]
        scale = np.float32(1 / np.log(10))
        return s1 * scale, s2 * scale, z * scale


def start(noise: np.ndarray) -> Model:
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.1, (CLASSES, SIZE))
    out = rng.normal(0, 0.1, (CLASSES, SIZE))
    eye = np.eye(SIZE)
    return Model.of(np.concatenate([r.ravel(), out.ravel(), eye.ravel(), (0.5 * eye).ravel(), np.log(noise)]))


def train(model: Model, noise: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = RATE) -> int:
    """Noise-contrastive steps over (two before, before, class) triples, by AdaGrad, in place. How many triples."""
    rng = np.random.default_rng(9)
    log_noise = np.log(NOISE * noise).astype(np.float32)
    cumulative = np.cumsum(noise)

    def by_row(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = rows.argsort(kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.concatenate((TRUE, rows[1:] != rows[:-1])))
        return rows[at], np.add.reduceat(grads[order], at, 0)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        """In place."""
        np.clip(x, -30, 30, out=x)
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)

    # targets with their biases in the last column
    target_of = np.concatenate((model.out, model.bias[:, None]), 1)
    size, grown = SIZE, [np.full_like(x, 1e-8) for x in (model.r, target_of, model.c1, model.c2)]

    def step(k: int, param: np.ndarray, grad: np.ndarray, rows: np.ndarray) -> None:
        squares = grown[k][rows]
        squares += grad * grad
        grown[k][rows] = squares
        np.sqrt(squares, out=squares)
        param[rows] -= rate * grad / squares

    def step_all(k: int, param: np.ndarray, grad: np.ndarray) -> None:
        grown[k] += grad * grad
        param -= rate * grad / np.sqrt(grown[k])

    ones = np.ones((BATCH, 1), np.float32)
    seen = 0
    for two, one, target in parts:
        order = rng.permutation(target.size)
        for at in range(0, order.size, BATCH):
            pick = order[at : at + BATCH]
            x1, x2, y = one[pick], two[pick], target[pick]
            k = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), CLASSES - 1)
            v1, v2, ty, tk = model.r[x1], model.r[x2], target_of[y], target_of[k]
            vy, vk = ty[:, :size], tk[:, :size]
            q = v1 @ model.c1
            q += v2 @ model.c2
            real = np.einsum("ij,ij->i", q, vy)
            real += ty[:, size] - log_noise[y]
            false = q @ vk.T
            false += tk[:, size] - log_noise[k]
            g_real = -sigmoid(np.negative(real, out=real))[:, None]
            g_false = sigmoid(false)
            g_q = g_false @ vk
            g_q += g_real * vy
            n = np.float32(1 / y.size)
            q1 = np.concatenate((q, ones[: y.size]), 1)  # a bias's gradient is that of a constant
            rows, g = by_row(np.concatenate((y, k)), np.concatenate((g_real * q1, g_false.T @ q1)) * n)
            step(1, target_of, g, rows)
            rows, g = by_row(np.concatenate((x1, x2)), np.concatenate((g_q @ model.c1.T, g_q @ model.c2.T)) * n)
            g1, g2 = v1.T @ g_q * n, v2.T @ g_q * n
            step(0, model.r, g, rows)
            step_all(2, model.c1, g1)
            step_all(3, model.c2, g2)
        seen += target.size
    model.out[:], model.bias[:] = target_of[:, :size], target_of[:, size]
    return seen


def contexts(cls: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two before and one before each token; before a text there are ends."""
    one, two = np.roll(cls, 1), np.roll(cls, 2)
    first = np.r_[True, rows[1:] != rows[:-1]]
    second = np.r_[False, first[:-1]]
    one[first], two[first], two[second] = TOP, TOP, TOP
    return two, one


def class_of(places: vec.Places, classes: np.ndarray, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and its place among the frequent words or -1."""
    at = places(h)
    cls = np.where(at >= 0, classes[at], TOP + 1 + tail) if classes.size else np.where(h == END, TOP, TOP + 1 + tail)
    return np.where(h == END, TOP, cls), at


def of_round(batches: Iterator[pa.RecordBatch], round_: int) -> Iterator[pa.RecordBatch]:
    """The texts that a round trains on. It is told by the text alone, so rounds agree on it however a scan deals its rows."""
    for batch in batches:
        buf, offs = vec.flat(batch.column("text"))
        bounds = offs.tolist()
        yield batch.filter(pa.array([zlib.crc32(buf[a:b]) % ROUNDS == round_ for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.bool_()))


def fit(docs: DataFrame, vocab: Vocabulary) -> Model:
    spark = docs.sparkSession
    noise = (vocab.class_tokens + 1.0) / (vocab.class_tokens + 1.0).sum()
    sent = spark.sparkContext.broadcast((vocab.hashes, vocab.classes, noise))
    model = start(noise).flat()
    for round_ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now, round_=round_) -> Iterator[pa.RecordBatch]:
            hashes, classes, noise = sent.value
            places = vec.Places(hashes, 19)
            own = Model.of(now.value.copy())

            def parts():
                for _, h, tail, rows in pieces(of_round(batches, round_)):
                    cls, _ = class_of(places, classes, h, tail)
                    yield *contexts(cls, rows), cls

            seen = train(own, noise, parts(), RATE / (1 + round_))
            if seen:
                x = own.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.size, dtype=np.int32)), pa.array(x), pa.array(np.full(x.size, float(seen)))], ["k", "x", "n"])

        mixed = docs.mapInArrow(common.tidy(run), "k int, x double, n double").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        now.destroy()
        if len(mixed):
            model = mixed.sort_values("k")["x"].to_numpy()
    sent.destroy()
    return Model.of(model)


def score(docs: DataFrame, vocab: Vocabulary, model: Model, counts: DataFrame) -> DataFrame:
    """``docs`` (doc_id, held_out, text) without the text, with n_tokens, n_known, base_score and score."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, (s1, s2, z) = sent.value
        places = vec.Places(vocab.hashes, 19)
        head_counts = vocab.counts.astype(float)
        head_base, head_inner = vocab.base(head_counts), vocab.inner(head_counts, vocab.classes)
        for part, h, tail, rows in pieces(batches):
            n = part.num_rows
            cls, at = class_of(places, vocab.classes, h, tail)
            two, one = contexts(cls, rows)
            log_p = (s1[one, cls] + s2[two, cls] - z[two, one]).astype(float)
            known = at >= 0
            if head_base.size:
                log_p += np.where(known, head_inner[at], 0.0)
                base = np.where(known, head_base[at], 0.0)
            else:
                base = np.zeros(h.size)
            sums = [np.bincount(rows, w, n) for w in (base, log_p)]
            rest = np.flatnonzero(~known)
            key = np.stack([rows[rest].astype(np.uint64), h[rest]], 1)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key, cl = key[order], cls[rest][order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(key)])
            bounds = pa.array(np.searchsorted(key[first, 0], np.arange(n + 1).astype(np.uint64)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (key[first, 1].view(np.int64), times.astype(np.int32), cl[first].astype(np.int32))]
            plain = [np.bincount(rows, minlength=n), np.bincount(rows, known, n).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([part.column(x) for x in ("doc_id", "_row", "held_out")] + [pa.array(x.astype(np.int64)) for x in plain] + [pa.array(x) for x in sums] + lists, names)

    names = ["doc_id", "_row", "held_out", "n_tokens", "n_known", "base_score", "score", "_h", "_times", "_cls"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, _row long, held_out boolean, n_tokens long, n_known long, base_score double, score double, _h array<long>, _times array<int>, _cls array<int>"
    first = common.materialise(docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(common.tidy(run), schema), "scored")
    rare = first.where(F.size("_h") > 0).select("_row", F.explode(F.arrays_zip("_h", "_times", "_cls")).alias("x"))
    rare = rare.select("_row", F.col("x._h").alias("h"), F.col("x._times").alias("times"), F.col("x._cls").alias("cls"))
    # bounded by CLASSES entries each
    tokens_ = F.array(*(F.lit(float(x)) for x in vocab.class_tokens[TOP + 1 :]))
    words_ = F.array(*(F.lit(float(x)) for x in vocab.class_words[TOP + 1 :]))
    at = F.greatest(F.col("cls") - TOP, F.lit(1))
    c = F.coalesce("c", F.lit(0))
    inner = F.when(F.col("cls") <= TOP, 0.0).otherwise(F.log10((c + 0.5) / (F.element_at(tokens_, at) + 0.5 * (F.element_at(words_, at) + 1))))
    base = F.log10((c + 0.5) / F.lit(vocab.total + 0.5 * (vocab.distinct + 1)))
    extra = rare.join(counts.select("h", "c"), "h", "left").groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * base).alias("b"), F.sum(F.col("times") * inner).alias("s")
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return first.join(extra, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero(F.col("b"))).alias("base_score"), (F.col("score") + zero(F.col("s"))).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", (common.fold("doc_id") == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = rows.where("not held_out").select("text")
    counts = count_tokens(training)
    vocab = vocabulary(counts)
    return score(rows, vocab, fit(training, vocab), counts)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
