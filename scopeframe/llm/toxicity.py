"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct words, word pairs, word triples and pairs with one word between, hashed to 2**BITS
places. Learning keeps a rate for each place and an L1 term that leaves most weights at nought, so what is broadcast is a
short list of places and weights, at most 2**BITS of them.

Learning reads at most ``labelled`` rows, those of the least hash of their ids; scoring reads all rows and whole texts.

Defined results: a null or empty text has the score of the bias alone; repeated rows give repeated results; of several
labels of one id the largest holds; null labels and labels of unknown ids teach nothing; without labels, every score is that
of no evidence (0, and 0.5 is never reached); a null id is never held out and never learnt from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

BITS = 20
#: The bound of the sample that is learnt from.
LABELLED = 16_000
#: ALPHA, L1 and WEIGHT have the least log loss of a grid of 16 on a part of the training rows (see the README).
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 2.0, 1.0, 20.0, 0.0, 8, 48
#: A toxic row counts as so many.
WEIGHT = 8.0


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows, with repeats."""
    low = vec.LOWER[buf]
    starts, ends, rows = vec.words(low, offs, vec.PUNCT)
    h = vec.hash_spans(low, starts, ends)
    out, own = [h], [rows]
    for gaps, salt in (((1,), 11), ((2,), 13), ((1, 2), 17)):
        far = gaps[-1]
        if h.size > far:
            same = rows[far:] == rows[:-far]
            g = h[:-far] * vec.M1 + np.uint64(salt)
            for k in gaps:
                g = vec.mix(g + h[k : h.size - far + k]) * vec.M1
            out.append(g[same])
            own.append(rows[:-far][same])
    places = np.concatenate(out)
    return (vec.mix(places) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(own)


def train(rows: list[tuple[np.ndarray, int]], alpha: float = ALPHA, l1_term: float = L1, weight: float = WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't nought, from each row's places and label. Place 2**BITS is the bias, without L1."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, l1_term)
    l1[-1] = 0
    order = np.random.default_rng(7).permutation(len(rows))
    batches = []
    for at in range(0, len(order), BATCH):
        own = [rows[i] for i in order[at : at + BATCH]]
        places = np.concatenate([np.r_[x, size - 1] for x, _ in own])
        unique, inverse = np.unique(places, return_inverse=True)
        batches.append((unique, inverse.astype(np.int32), np.cumsum([0, *(len(x) + 1 for x, _ in own)]), np.array([y for _, y in own], float)))

    def weights(at: np.ndarray) -> np.ndarray:
        big = np.abs(z[at]) > l1[at]
        return np.where(big, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / alpha + L2), 0.0)

    for _ in range(EPOCHS):
        for unique, inverse, bounds, y in batches:
            w = weights(unique)
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[inverse], bounds[:-1]), -35, 35)))
            each = np.repeat((p - y) * np.where(y > 0, weight, 1.0), np.diff(bounds))
            g = np.bincount(inverse, each, unique.size)
            # each row's own square, as one row at a time would give
            square = np.bincount(inverse, each * each, unique.size)
            sigma = (np.sqrt(n[unique] + square) - np.sqrt(n[unique])) / alpha
            z[unique] += g - sigma * w
            n[unique] += square
    at = np.arange(size)
    w = weights(at)
    keep = np.flatnonzero(w)
    return keep, w[keep]


def sample(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """doc_id and toxic of the rows to learn from, at most ``labelled``."""
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.where(common.fold("doc_id") != 0)
    return common.least(rows, F.xxhash64("doc_id"), labelled, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Weights. The sample's size is bounded by ``labelled``, so its ids may be broadcast and one task can learn."""
    chosen = common.materialise(sample(docs, labels, labelled).withColumnRenamed("doc_id", "_id"), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = vec.flat(batch.column("text"))
            for a, b in vec.slices(offs, 1 << 21):
                own = offs[a : b + 1]
                places, rows = features(buf[own[0] : own[-1]], own - own[0])
                key = np.unique(rows << BITS | places)
                bounds = np.searchsorted(key >> BITS, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, batch.column("toxic").slice(a, b - a)], ["doc_id", "places", "toxic"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            offs = batch.column("places").offsets.to_numpy()
            values = batch.column("places").values.to_numpy()
            for i, (key, toxic) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), strict=True)):
                rows.append((key, values[offs[i] : offs[i + 1]].copy(), toxic))
        rows.sort(key=lambda x: (x[0], x[1].size))
        places, weights = train([x[1:] for x in rows]) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(weights)], ["place", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", "text", "toxic").mapInArrow(common.tidy(extract), f"doc_id {id_type}, places array<int>, toxic int")
    model = found.repartition(1).mapInArrow(common.tidy(learn), "place long, weight double").toPandas()
    return model["place"].to_numpy(), model["weight"].to_numpy()


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray]):
    """An Arrow UDF from text to score."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        places, weights = sent.value
        table = np.zeros((1 << BITS) + 1)
        table[places] = weights
        buf, offs = vec.flat(column)
        out = np.full(len(column), table[-1] if len(places) else -40.0)
        for a, b in vec.slices(offs, 1 << 20):
            own = offs[a : b + 1]
            at, rows = features(buf[own[0] : own[-1]], own - own[0])
            some = table[at] != 0
            key = np.unique(rows[some] << BITS | at[some])
            out[a:b] += np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], b - a)
        common.give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[DataFrame, Column]:
    """``docs`` itself, and the column of its scores."""
    return docs, scorer(docs.sparkSession, fit(docs, labels, labelled))(F.coalesce("text", F.lit("")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    docs, score = score_documents(docs, labels)
    return docs.where(score < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, score = score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", (common.fold("doc_id") == 0).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
