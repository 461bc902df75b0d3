"""N-gram Jaccard join: documents whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

1. One scan gives each document its set's fingerprint and its MinHash bands. Documents of equal sets form a class, and
   only a class's first document goes on.
2. Classes meet on band hashes. A bucket gives one edge for each member, to its least member; the components of these
   edges hold all candidate pairs.
3. A component is cut into blocks by set size and by hash. Pairs of blocks are verified on the full sets, each in a task of
   bounded size; a task gives link counts and a spanning forest rather than pairs. So a group of many near copies is split
   over many tasks, and no pair of it is left out or written out.
4. Groups are the components of the verified links.

Words are runs of bytes other than white space and ASCII punctuation, with A-Z lower-cased.

Defined results: null and empty texts, and those without words, have the empty set, form one class and have no links; a text
of fewer than five words has one run of all its words; rows that repeat an id and a text are of one class; a null id comes
after all others, and rows without an id, or of different texts under one id, are documents of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, vec

WORDS, SIMILARITY, ROWS, RECALL = 5, 0.8, 6, 0.999
#: The most members and set elements of a block; a single larger set is a block of its own.
BLOCK_MEMBERS, BLOCK_ELEMENTS = 256, 200_000


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` rows by which a pair at the threshold meets with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def doc_sets(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes, ascending in each row, and their rows."""
    low = vec.LOWER[buf]
    starts, ends, rows = vec.words(low, offs, vec.PUNCT)
    return vec.sets(*vec.shingles(vec.hash_spans(low, starts, ends), rows, n))


def set_keys(h: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set."""
    out = np.zeros((2, count), np.uint64)
    if h.size:
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for k, salt in enumerate((3, 5)):
            out[k, rows[at]] = np.add.reduceat(vec.mix(h + np.uint64(salt)), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def band_hashes(h: np.ndarray, rows: np.ndarray, count: int, bands: int, n: int) -> np.ndarray:
    """count x bands; rows without elements have noughts."""
    rng = np.random.default_rng(11)
    xors, odds = rng.integers(0, 1 << 32, bands * n, np.uint32), rng.integers(0, 1 << 31, bands * n, np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((count, bands), np.uint64)
    if h.size:
        small = (h >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        own = rows[at]
        for b in range(bands):
            key = np.full(own.size, np.uint64(b + 1))
            for k in range(b * n, b * n + n):
                value = (small ^ xors[k]) * odds[k]
                key = vec.mix(key * vec.M1 + np.minimum.reduceat(value ^ (value >> np.uint32(15)), at))
            out[own, b] = key
    return out


def signatures(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """_row, _id, c1, c2 (the set's fingerprints), n (its size) and bands for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = vec.flat(batch.column("text"))
            for a, b in vec.slices(offs, 1 << 20):
                own, count = offs[a : b + 1] - offs[a], b - a
                h, at = doc_sets(buf[offs[a] : offs[b]], own, words)
                c1, c2 = set_keys(h, at, count)
                sizes = np.bincount(at, minlength=count).astype(np.int64)
                bands_ = band_hashes(h, at, count, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * bands, bands, dtype=np.int32)), pa.array(bands_.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, count) for c in ("_row", "_id")), pa.array(c1), pa.array(c2), pa.array(sizes), lists], ["_row", "_id", "c1", "c2", "n", "bands"])

    return common.materialise(docs.mapInArrow(common.tidy(run), "_row long, _id long, c1 long, c2 long, n long, bands array<long>"), "signatures")


def candidates(classes: DataFrame) -> DataFrame:
    """(node, root): classes that may have links, with their candidate component."""
    rows = classes.where("n > 0").select("rep", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    buckets = common.materialise(buckets, "buckets")
    edges = rows.join(buckets, "band").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return common.materialise(graph.components(edges), "candidates")


def blocks(classes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """rep, and a row for each pair of blocks that the class is part of: root, kind, band, p, q, side."""
    step = -math.log(similarity)
    # a hair is added so that rounding never parts sizes at the very ratio by more than one band
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step * (1 + 1e-9))).cast("int")
    members = classes.select("rep", "n").join(roots, F.col("rep") == F.col("node")).select("rep", "n", "root", band.alias("band"))
    members = common.materialise(members, "members")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    counted = members.groupBy("root", "band").agg(parts.alias("parts"), F.count("*").alias("size"))
    maps = counted.groupBy("root").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"),
        F.map_from_entries(F.collect_list(F.struct("band", "size"))).alias("sizes"),
    )  # a map holds as many entries as there are size bands, which grow with the logarithm of the largest set
    maps = common.materialise(maps, "blocks")
    rows = members.join(maps, "root")
    part = lambda d: F.coalesce(F.try_element_at("parts", F.col("band") + d), F.lit(0))
    salt = F.pmod(F.xxhash64("rep"), part(0)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda kind, band, p, q, side: F.struct(F.lit(kind).alias("kind"), band.alias("at"), p.alias("p"), q.alias("q"), side.alias("side"))
    own = F.when(F.try_element_at("sizes", F.col("band")) > 1, upto(part(0))).otherwise(F.array().cast("array<int>"))
    keys = F.concat(
        F.transform(own, lambda s: key(0, F.col("band"), F.least(s, F.col("salt")), F.greatest(s, F.col("salt")), (F.col("salt") > s).cast("int"))),
        F.transform(upto(part(1)), lambda s: key(1, F.col("band"), F.col("salt"), s, F.lit(0))),
        F.transform(upto(part(-1)), lambda s: key(1, F.col("band") - 1, s, F.col("salt"), F.lit(1))),
    )
    return rows.withColumn("salt", salt).select("rep", "root", F.explode(keys).alias("k")).select("rep", "root", "k.*")


def intersections(h: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """count x count sizes of the sets' intersections, by dense products over runs of the shared elements."""
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    new = np.r_[True, h[1:] != h[:-1]] if h.size else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if h.size else new
    rows, column = rows[shared], column[shared]
    out = np.zeros((count, count), np.float32)
    if not rows.size:
        return out
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]])
    width = max(256, (1 << 21) // max(count, 1))
    for at in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((count, min(width, int(column[-1]) + 1 - at)), np.float32)
        dense[rows[a:b], column[a:b] - at] = 1
        out += dense @ dense.T
    return out


def verify(similarity: float, words: int):
    """Of a pair of blocks: rep, links and a root in the spanning forest of the links found here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        buf, offs = vec.flat(table["text"])
        reps, side = table["rep"].to_numpy(), table["side"].to_numpy()
        h, at = doc_sets(buf, offs, words)
        n = len(reps)
        sizes = np.bincount(at, minlength=n).astype(np.float64)
        common_ = intersections(h, at, n).astype(np.float64)
        union = sizes[:, None] + sizes[None, :] - common_
        linked = common_ >= similarity * union - 1e-9
        one = table["kind"][0].as_py() == 0 and table["p"][0].as_py() == table["q"][0].as_py()
        if one:
            np.fill_diagonal(linked, False)
        else:
            linked &= side[:, None] != side[None, :]
        root = np.arange(n)
        while True:  # labels fall to the least of the neighbours' until none changes
            least = np.where(linked, root[None, :], n).min(1, initial=n)
            new = np.minimum(root, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        links = linked.sum(1)
        got = links > 0
        return pa.table({"rep": reps[got], "links": links[got].astype(np.int64), "root": reps[root[got]]})

    return run


def near_rows(keyed: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """:func:`near_duplicates` of a table of :func:`common.keyed`, with _row and _head, the row that stands for the group.

    Classes and links are told by rows, as ids can be null or repeated."""
    docs = keyed.select("_row", F.col("_doc.doc_id").cast("long").alias("_id"), F.coalesce("_doc.text", F.lit("")).alias("text"))
    marks = signatures(docs, words, rows, bands_for(similarity, rows, recall))
    key = ["c1", "c2", "n"]
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))
    classes = marks.groupBy(*key).agg(least.alias("least"), F.count("*").alias("class_size"), F.first("bands").alias("bands"))
    classes = common.materialise(classes.withColumn("rep", F.col("least._row")), "set-classes")
    pairs = blocks(classes, candidates(classes), similarity)
    met = pairs.join(docs.select("_row", "text"), F.col("rep") == F.col("_row")).drop("_row")
    found = met.groupBy("root", "kind", "at", "p", "q").applyInArrow(common.tidy(verify(similarity, words)), "rep long, links long, root long")
    found = common.materialise(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups = graph.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    about = classes.drop("bands").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    about = common.materialise(about.select(*key, "least", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rep").alias("root")), "groups")
    heads = common.materialise(about.groupBy("root").agg(F.min("least").alias("head")), "heads")
    about = common.materialise(about.join(heads, "root").drop("root"), "headed")
    return marks.select("_row", "_id", *key).join(about, key).select(
        "_row", F.col("head._row").alias("_head"), F.col("_id").alias("doc_id"), F.col("least._id").alias("class_id"), "class_size", "n_links", F.col("head._id").alias("group_id")
    )


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the least id of the texts with the same set), class_size,
    n_links (how many other classes the class is linked to) and group_id (the least id of those joined by links)."""
    return near_rows(common.keyed(docs.select("doc_id", "text")), **settings).drop("_row", "_head")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group, that of the least id; its own columns."""
    keyed = common.keyed(docs)
    gone = common.materialise(near_rows(keyed, **settings).where("_row <> _head").select("_row"), "near-copies")
    return keyed.join(common.small(gone), "_row", "left_anti").select("_doc.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
