"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is its bytes' polynomial modulo two primes, with its length. A chunk's hash, shifted by the bytes
that follow it in the text, is one term of the sum, so chunks of one huge text can be hashed anywhere and in any order.
Texts of equal fingerprints are then compared chunk by chunk; should they differ, SHA-256 parts them.

Defined results: a null text is empty; empty texts equal one another; a text of white space only is one space; a null id
comes after all others; rows that repeat an id and a text are copies like others (the stage keeps one of them); different
texts under one id, or without one, are apart; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

CHUNK = 1 << 18
#: The two primes are under 2**31, so that products of residues stay under 2**62.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    step = base % prime
    while out.size < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


def chunk_terms(buf: np.ndarray, offs: np.ndarray, after: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Each row's polynomial shifted by ``after`` bytes, for either prime. Rows are of at most CHUNK bytes."""
    size = np.diff(offs)
    out = []
    last = np.repeat(offs[1:] - 1, size) - np.arange(buf.size)
    full = np.flatnonzero(size)
    for prime, base, table in zip(PRIMES, BASES, tables, strict=True):
        h = np.zeros(size.size, np.uint64)
        if buf.size:
            # a byte and one more, times a residue under 2**31: 2**21 such products stay under 2**63
            product = (buf.astype(np.uint64) + np.uint64(1)) * table[last]
            h[full] = np.add.reduceat(product, offs[:-1][full]) % np.uint64(prime)
        for i in np.flatnonzero(after):
            h[i] = int(h[i]) * pow(base, int(after[i]), prime) % prime
        out.append(h.astype(np.int64))
    return out


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunked(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, chunk number, bytes that follow it, and the chunk of each row's binary ``_t``."""
    n = F.greatest(F.ceil(F.octet_length("_t") / CHUNK).cast("int"), F.lit(1))
    return rows.withColumn("_no", F.explode(F.sequence(F.lit(0), n - 1))).select(
        *keep,
        "_no",
        F.greatest(F.octet_length("_t") - (F.col("_no") + 1) * CHUNK, F.lit(0)).cast("long").alias("_after"),
        F.substring(F.col("_t"), F.col("_no") * CHUNK + 1, F.lit(CHUNK)).alias("_chunk"),
    )


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]
    for batch in batches:
        buf, offs = vec.flat(batch.column("_chunk"))
        after = batch.column("_after").to_numpy(zero_copy_only=False)
        for a, b in vec.slices(offs, 1 << 21):
            own = offs[a : b + 1]
            f1, f2 = chunk_terms(buf[own[0] : own[-1]], own - own[0], after[a:b], tables)
            rest = [batch.column(c).slice(a, b - a) for c in ("doc_id", "_row", "_sha", "_bytes")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(f1), pa.array(f2)], ["doc_id", "_row", "_sha", "_bytes", "_f1", "_f2"])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, _row (``row``, or what tells repeated rows apart), _sha, _bytes, _f1, _f2 for each row."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select("doc_id", row.alias("_row"), normalised().cast("binary").alias("_t"))
    rows = rows.select("doc_id", "_row", F.sha2("_t", 256).alias("_sha"), F.octet_length("_t").cast("long").alias("_bytes"), "_t")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    terms = chunked(rows, "doc_id", "_row", "_sha", "_bytes").mapInArrow(
        common.tidy(_hash_chunks), f"doc_id {id_type}, _row long, _sha string, _bytes long, _f1 long, _f2 long"
    )
    sums = terms.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "_sha", "_bytes")),
        *((F.sum(f"_f{k}") % PRIMES[k - 1]).alias(f"_f{k}") for k in (1, 2)),
    )
    return common.materialise(sums, "fingerprints")


def _classes(marks: DataFrame, key: list[str]) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))
    return marks.groupBy(*key).agg(first.alias("_keep"), F.count("*").alias("group_size"))


def differing(docs: DataFrame, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """The fingerprints under which some chunk differs: the chunkwise comparison of all rows of shared fingerprints.

    Equal chunks collapse before the shuffle, so a large group costs a task no more than one text."""
    key = ["_bytes", "_f1", "_f2"]
    shared = marks.join(classes.where("group_size > 1").select(*key), key).select(F.col("doc_id").alias("_id"), *key).distinct()
    texts = docs.select(F.col("doc_id").alias("_d"), normalised().cast("binary").alias("_t"))
    rows = texts.join(shared, F.col("_d").eqNullSafe(F.col("_id"))).where(F.octet_length("_t") == F.col("_bytes"))
    return (
        chunked(rows, *key)
        .groupBy(*key, "_no")
        .agg(F.min("_chunk").alias("_lo"), F.max("_chunk").alias("_hi"))
        .where("_lo <> _hi")
        .select(*key)
        .distinct()
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and _row_kept, which is true for
    one row of each group only."""
    return row_groups(docs).drop("_row")


def row_groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """:func:`exact_groups` with _row, which is ``row`` if given."""
    key = ["_bytes", "_f1", "_f2"]
    marks = fingerprints(docs, row)
    classes = common.materialise(_classes(marks, key), "classes")
    bad = common.materialise(differing(docs, marks, classes), "differing")
    if not bad.isEmpty():
        key = [*key, "_sha"]
        classes = common.materialise(_classes(marks, key), "classes")
    same = F.col("doc_id").eqNullSafe(F.col("_keep.doc_id"))
    return marks.join(classes, key).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        same.alias("kept"),
        F.col("_sha").alias("text_sha256"),
        (same & (F.col("_row") == F.col("_keep._row"))).alias("_row_kept"),
        "_row",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without copies, with its own columns."""
    keyed = common.keyed(docs)
    groups = row_groups(keyed.select("_doc.doc_id", "_doc.text", "_row"), F.col("_row"))
    gone = common.materialise(groups.where("not _row_kept").select("_row"), "copies")
    return keyed.join(common.small(gone), "_row", "left_anti").select("_doc.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents")).drop("_row_kept")


SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents),
g as (select x, min(doc_id) as keep_id, count(*) as group_size from t group by x)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from t join g using (x)
"""
