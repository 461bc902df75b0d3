"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

Each document is cut into overlapping passages, and each passage is a query. An item's threshold is a share of the score it
gives itself. WAND's pivot is taken item by item: an item's terms of least weight that together stay under its threshold can't
reach it alone, so only the other (essential) terms have postings that begin a candidate. A candidate's block of items is then
bounded by its terms' block maxima, and only blocks that may reach a threshold are scored. All items at or above their threshold
are retrieved, and verified on the whole document: 0.8 of the five-word runs that touch the question, and 0.8 of those that touch
the answer, must be in it. The answer is an item's last line, or else its last sentence, or else its last third.

The index is broadcast only up to INDEX_BYTES of items; more items are taken in as many parts, with statistics over all items.
One scan of the documents a part, whose broadcast goes before the next is made. A single part needs no shuffle; of more, hashes of
the texts that hold an item are shuffled.

Defined results: null and empty texts, and those without words, match nothing; items without words match nothing; an item of
fewer than five words must be found as a run of all its words; items of equal texts match alike; repeated rows give repeated
results; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

WORDS, OVERLAP = 5, 0.8
#: Words of a passage, and from one passage's start to the next one's.
PASSAGE, STRIDE = 128, 64
#: Share of an item's own score that a passage must reach.
SHARE = 0.5
K1, B = 1.2, 0.75
BLOCK = 8
INDEX_BYTES = 16 << 20
#: Block maxima are looked up in a matrix of up to so many entries, else in sorted keys.
DENSE = 4 << 20


def question_words(text: str) -> int:
    """How many words come before the answer."""
    parts = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)
    for cut in ("\n", ". "):
        head, found, tail = text.rstrip().rpartition(cut)
        if found and re.search(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", tail) and head.strip():
            n = len(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", head))
            if 0 < n < len(parts):
                return n
    return max(len(parts) * 2 // 3, min(1, len(parts)))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = vec.flat(texts)
    low = vec.LOWER[buf]
    starts, ends, rows = vec.words(low, offs, vec.PUNCT)
    return vec.hash_spans(low, starts, ends), rows


@dataclass
class Index:
    """items: ids; terms: sorted hashes; keys: term * items + item, sorted, with impacts; tops: the same by block of items."""

    items: np.ndarray
    terms: np.ndarray
    keys: np.ndarray
    impacts: np.ndarray
    top_keys: np.ndarray
    tops: np.ndarray
    thresholds: np.ndarray
    least: np.ndarray  # by block
    essential: np.ndarray  # sorted term numbers
    essential_from: np.ndarray  # bounds of each one's blocks in essential_blocks
    essential_blocks: np.ndarray
    sieve: np.ndarray  # bits of the essential hashes
    runs: list[tuple[int, np.ndarray, np.ndarray]]  # of each item: words a run, runs of the question, runs of the answer
    dense: np.ndarray | None  # terms x blocks of block maxima, if that is small
    size: int  # items of a block

    @property
    def blocks(self) -> int:
        return len(self.least)


def build(ids: list, texts: list[str], frequency: dict[int, int], count: int, mean: float) -> Index:
    """frequency: items that hold a term, by hash; count and mean length: over all items."""
    h, rows = hashed(pa.array(texts, pa.string()))
    n = len(ids)
    lengths = np.bincount(rows, minlength=n)
    terms, number = np.unique(h, return_inverse=True)
    key, tf = np.unique(number.astype(np.int64) * n + rows, return_counts=True)
    term, item = key // max(n, 1), key % max(n, 1)
    df = np.array([frequency.get(x, 1) for x in terms.view(np.int64).tolist()], float)
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(mean, 1e-9))) if key.size else np.zeros(0)
    own = np.bincount(item, impact, n) if key.size else np.zeros(n)
    # a passage is sure to hold the whole of an item of up to STRIDE words, or else as many of its words
    thresholds = np.where(own > 0, SHARE * own * np.minimum(1, STRIDE / np.maximum(lengths, 1)), np.inf)
    blocks = (n + BLOCK - 1) // BLOCK
    pair = term * max(blocks, 1) + item // BLOCK
    top_keys, at = np.unique(pair, return_index=True)
    order = np.argsort(pair, kind="stable")
    tops = np.maximum.reduceat(impact[order], np.searchsorted(pair[order], top_keys)) if pair.size else impact
    least = np.array([thresholds[b * BLOCK : (b + 1) * BLOCK].min() for b in range(blocks)])
    order = np.lexsort((impact, item))
    sums = np.cumsum(impact[order])
    first = np.searchsorted(item[order], np.arange(n))
    before = np.r_[0.0, sums][first]
    needed = order[sums - before[item[order]] >= thresholds[item[order]] - 1e-9]
    chosen = np.unique(pair[needed])
    essential, start = np.unique(chosen // max(blocks, 1), return_index=True)
    sieve = np.zeros(1 << 20, bool)
    sieve[(terms[essential] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    dense = None
    if terms.size * blocks <= DENSE:
        dense = np.zeros((terms.size, blocks))
        dense[top_keys // max(blocks, 1), top_keys % max(blocks, 1)] = tops
    runs = []
    for i, text in enumerate(texts):
        mine = h[rows == i]
        k = min(WORDS, len(mine))
        if not k:
            runs.append((0, mine, mine))
            continue
        grams, _ = vec.shingles(mine, np.zeros(len(mine), np.int64), k)
        q, begin = question_words(text), np.arange(len(grams))
        runs.append((k, np.unique(grams[begin < max(q, 1)]), np.unique(grams[begin + k > q])))
    return Index(np.array(ids), terms, key, impact, top_keys, tops, thresholds, least, essential, np.r_[start, chosen.size], chosen % max(blocks, 1), sieve, runs, dense, BLOCK)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the owner of each of sum(c) rows, and its rank."""
    owner = np.repeat(np.arange(counts.size), counts)
    return owner, np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)


def found_in(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Values at keys; nought where a key isn't there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), sorted_keys.size - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0.0)


def retrieve(index: Index, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of all items that some passage of the row scores at or above their threshold."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not h.size or not index.essential.size:
        return none
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[start, h.size])
    ordinal = np.cumsum(np.r_[False, rows[1:] != rows[:-1]])
    rank = np.arange(h.size) - np.repeat(start, size)
    passages = np.maximum((size - PASSAGE + STRIDE - 1) // STRIDE, 0) + 1
    base = np.cumsum(passages) - passages

    def of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages of the words at ``at``: (index into at, passage)."""
        d, r = ordinal[at], rank[at]
        lo = np.maximum((r - PASSAGE) // STRIDE + 1, 0)
        hi = np.minimum(r // STRIDE, passages[d] - 1)
        owner, k = expand(np.maximum(hi - lo + 1, 0))
        return owner, base[d][owner] + lo[owner] + k

    maybe = np.flatnonzero(index.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    names = index.terms[index.essential]
    place = np.minimum(np.searchsorted(names, h[maybe]), names.size - 1)
    hit = names[place] == h[maybe]
    maybe, place = maybe[hit], place[hit]
    if not maybe.size:
        return none
    owner, passage = of(maybe)
    place = place[owner]
    spread, k = expand(index.essential_from[place + 1] - index.essential_from[place])
    pair = np.unique(passage[spread] * index.blocks + index.essential_blocks[index.essential_from[place[spread]] + k])
    passage, block = pair // index.blocks, pair % index.blocks
    # the distinct index terms of the candidate passages
    wanted = np.unique(passage)
    row_of = np.searchsorted(base, wanted, "right") - 1
    first = start[row_of] + (wanted - base[row_of]) * STRIDE
    length = np.minimum(PASSAGE, start[row_of] + size[row_of] - first)
    owner, k = expand(length)
    word = h[first[owner] + k]
    at = np.minimum(np.searchsorted(index.terms, word), index.terms.size - 1)
    known = index.terms[at] == word
    holds = np.unique(owner[known] * index.terms.size + at[known])
    holds_p, holds_t = holds // index.terms.size, holds % index.terms.size
    bounds = np.searchsorted(holds_p, np.arange(wanted.size + 1))
    p = np.searchsorted(wanted, passage)
    if index.dense is not None:
        # all blocks' bounds of a passage at once
        bound = np.empty(p.size)
        for a, b in vec.slices(bounds, 1 << 17):
            sums = np.add.reduceat(index.dense[holds_t[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a], 0)
            lo, hi = np.searchsorted(p, [a, b])
            bound[lo:hi] = sums[p[lo:hi] - a, block[lo:hi]]
    else:
        owner, k = expand(bounds[p + 1] - bounds[p])
        term = holds_t[bounds[p[owner]] + k]
        bound = np.bincount(owner, found_in(index.top_keys, index.tops, term * index.blocks + block[owner]), p.size)
    alive = np.flatnonzero(bound >= index.least[block] - 1e-9)
    n = index.items.size
    inside, k = expand(np.minimum(index.size, n - block[alive] * index.size))
    item, p = block[alive][inside] * index.size + k, p[alive][inside]
    owner, k = expand(bounds[p + 1] - bounds[p])
    term = holds_t[bounds[p[owner]] + k]
    score = np.bincount(owner, found_in(index.keys, index.impacts, term * n + item[owner]), p.size)
    good = score >= index.thresholds[item] - 1e-9
    both = np.unique(rows[start[row_of[p[good]]]] * n + item[good])
    return both // n, both % n


def match(index: Index, texts: pa.Array) -> list[list]:
    """The items that each text holds."""
    out: list[list] = [[] for _ in range(len(texts))]
    _, offs = vec.flat(texts)
    for a, b in vec.slices(offs, 1 << 20):
        h, rows = hashed(texts.slice(a, b - a))
        got, items = retrieve(index, h, rows)
        for row in np.unique(got):
            lo, hi = np.searchsorted(rows, [row, row + 1])
            own, grams = h[lo:hi], {}
            for item in items[got == row]:
                k, question, answer = index.runs[item]
                if k and len(own) >= k:
                    if k not in grams:
                        grams[k] = vec.shingles(own, np.zeros(own.size, np.int64), k)[0]
                    if all(np.isin(x, grams[k]).mean() >= OVERLAP for x in (question, answer) if x.size):
                        out[a + int(row)].append(int(index.items[item]))
            out[a + int(row)].sort()
    return out


def indexes(benchmark: DataFrame) -> tuple[int, Iterator[Index]]:
    """The number of parts of the items, and an index for each, built as it is asked for; a part's size is bounded, and
    statistics are over all items."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = hashed(batch.column("text"))
            pairs = np.unique(np.stack([at.astype(np.uint64), h], 1), axis=0) if h.size else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64).copy()), pa.array(np.full(len(pairs), len(h) / max(len(pairs), 1)))], ["term", "length"])

    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-size // INDEX_BYTES))
    words = rows.mapInArrow(terms, "term long, length double")
    total = words.agg(F.coalesce(F.sum("length"), F.lit(0.0))).first()[0]
    frequency = words.groupBy("term").agg(F.count("*").alias("df"))

    def part_index(part: int) -> Index:
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else rows
        known = frequency if parts == 1 else frequency.join(mine.mapInArrow(terms, "term long, length double").select("term").distinct(), "term", "left_semi")
        # items of like length share a block, so that its least threshold is near all of theirs
        items = sorted(((x["item_id"], x["text"]) for x in mine.toLocalIterator()), key=lambda x: (len(x[1]), x))
        return build([x[0] for x in items], [x[1] for x in items], {x["term"]: x["df"] for x in known.toLocalIterator()}, count, total / max(count, 1))

    return parts, map(part_index, range(parts))


def _matcher(sent):
    @F.arrow_udf("array<long>")
    def items(column: pa.Array) -> pa.Array:
        found = match(sent.value, column)
        common.give_back()
        return pa.array(found, pa.list_(pa.int64()))

    return items


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with a struct ``_doc`` of its columns, and the column of the sorted ids of the items that a text holds.

    One part of an index is a column of a single scan. Of more, each has a scan of its own, which writes the few texts that hold
    an item of it; its broadcast is destroyed before the next is made, so that an executor holds one part at a time."""
    spark = docs.sparkSession
    text = F.coalesce("_doc.text", F.lit(""))
    rows = docs.select(F.struct("*").alias("_doc"))
    parts, built = indexes(benchmark)
    if parts == 1:
        return rows, _matcher(spark.sparkContext.broadcast(next(built)))(text)
    key = common.row_key(rows, text)
    found = []
    for index in built:
        sent = spark.sparkContext.broadcast(index)
        hits = rows.select(key.alias("_text"), _matcher(sent)(text).alias("_items"))
        found.append(common.materialise(hits.where(F.size("_items") > 0).dropDuplicates(["_text"]), "part-items"))
        sent.destroy()
    merged = reduce(DataFrame.unionByName, found).groupBy("_text").agg(F.array_sort(F.flatten(F.collect_list("_items"))).alias("_items"))
    merged = common.materialise(merged, "all-items")
    # a text's items are few words; a join on a hash of the text moves the texts only where hits are too many to broadcast
    met = rows.withColumn("_text", key).join(common.small(merged), "_text", "left")
    return met, F.coalesce("_items", F.array().cast("array<bigint>"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, items = contamination(docs, benchmark)
    return rows.where(F.size(items) == 0).select("_doc.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_ids, n_items, contaminated for each document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, items = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    rows = rows.select("_doc.doc_id", items.alias("item_ids"))
    return rows.withColumns({"n_items": F.size("item_ids"), "contaminated": F.size("item_ids") > 0})
