"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere are removed.

1. A scan picks anchors: of each 200-byte window, the 96-byte string in it with the least hash (the leftmost on ties). Equal
   windows have equal anchors at equal places, and a window has one anchor only. What an anchor owns is a run of windows; its
   context is the text of these. Only anchors that occur twice can own a repeated window.
2. Equal contexts collapse into one with a count. An anchor with one context needs no sorting: it repeats or it doesn't.
3. The contexts of other anchors go to shards by anchor. A shard sorts all suffixes by Larsson-Sadakane refinement in numpy,
   from 8 bytes by doubling to 200, only groups not yet sorted being sorted again, and takes common prefixes by Kasai's
   method, in step over all contexts. Suffixes with a neighbour of 200 or more common bytes are repeated windows.
4. An anchor with more contexts than a shard takes is cut into several shards. Each sends its distinct windows, once, as sorted
   runs of digests (128 bits), cut at the same digests in all shards; runs are merged two by two by binary search, and a shard
   gets back which of its windows occur more than once. So no task grows with the number of texts that share a passage, and a
   window that many texts share is one entry of a run.
5. Marked windows go back to all occurrences, and become byte ranges of each document.

Defined results: a null text is empty; texts under 200 bytes lose nothing; matches never cross documents; a document's own
repeats count, overlapping ones too; rows that repeat an id and a text are separate documents that repeat each other; rows
without an id, and different texts under one id, are documents of their own, told by a hash of id and text; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

LENGTH, ANCHOR = 200, 96
#: Anchors are picked in pieces of so many bytes, whose hashes stay in a core's cache.
PIECE = 1 << 15
#: Bytes of contexts in a shard, and the most contexts of one anchor in it.
SHARD_BYTES, SHARD_CONTEXTS = 2 << 20, 2048
#: Windows of an anchor in a merge.
MERGE_ROWS = 500_000
#: Shards are dealt over so many tasks at most.
MOST_TASKS = 20_000
MARKS = "h long, c long, a array<int>, b array<int>"


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * vec.M1
    x += b
    x ^= x >> np.uint64(29)
    x *= vec.M2
    return x


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last owned window start (places in ``buf``) of each anchor. ``anchor`` is 96 and ``length``
    from 192 to 256 in the compiled steps below."""
    found = []
    n = buf.size
    ends = offs[1:]
    for at in range(0, max(n - length + 1, 0), PIECE):
        part = buf[at : at + PIECE + length]
        full = part.size
        h8 = vec.loads(part)[: full - 7]
        h8 = h8 ^ (h8 >> np.uint64(31))
        h8 *= vec.M3
        h16 = join_hash(h8[:-8], h8[8:])
        h32 = join_hash(h16[:-16], h16[16:])
        h64 = join_hash(h32[:-32], h32[32:])
        h = join_hash(h64[: full - anchor + 1], h32[64 : full - anchor + 65])
        key = (h & ~np.uint64((1 << 19) - 1)) | np.arange(h.size, dtype=np.uint64)
        width = length - anchor + 1
        low, reach = key, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            gap = width - reach
            low = np.minimum(low[:-gap], low[gap:])
        low = low[: min(PIECE, full - length + 1)]
        # an anchor's windows follow one another; they end before a text's last ``length`` - 1 bytes
        first = np.flatnonzero(low[1:] != low[:-1]) + 1
        cuts = np.concatenate([ends, ends - length + 1])
        cuts = cuts[(cuts > at) & (cuts < at + low.size)] - at
        first = np.unique(np.concatenate([np.zeros(1, np.int64), first, cuts]))
        last = np.append(first[1:] - 1, low.size - 1)
        place = (low[first] & np.uint64((1 << 19) - 1)).astype(np.int64)
        ok = first + at + length <= ends[np.minimum(np.searchsorted(ends, first + at, "right"), ends.size - 1)]
        first, last, place = first[ok], last[ok], place[ok]
        if first.size:
            found.append((h[place], place + at, first + at, last + at))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    h, place, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # what two pieces share is one anchor's
    return h[new], place[new], lo[new], hi[np.r_[new[1:], place.size] - 1]


def context_hash(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of each context, independent of the anchors' hash: the windows at its two ends cover it."""
    at = vec.loads(buf)
    out = (hi - lo).astype(np.uint64) * vec.M2 + (place - lo).astype(np.uint64)
    for base in (lo, hi):
        for k in [*range(0, length - 7, 8), length - 8]:
            out = (out ^ at[base + k]) * vec.M1
            out ^= out >> np.uint64(32)
    return vec.mix(out)


def anchor_rows(docs: DataFrame, hashes_only: bool) -> DataFrame:
    """h; or h, c, _row, lo and hi (first and last owned window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = vec.flat(batch.column("text"))
            for a, b in vec.slices(offs, 2 << 20):
                own = offs[a : b + 1] - offs[a]
                data = buf[offs[a] : offs[b]]
                h, place, lo, hi = anchors(data, own)
                if hashes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
                    continue
                c = context_hash(data, lo, hi, place)
                doc = np.searchsorted(own, lo, "right") - 1
                base = own[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column("_row").slice(a, b - a).take(pa.array(doc)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
                    ["h", "c", "_row", "lo", "hi"],
                )

    return docs.mapInArrow(common.tidy(run), "h long" if hashes_only else "h long, c long, _row long, lo int, hi int")


def suffix_order(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of the texts [starts, ends) that lie one after another in ``buf``, each ended by a symbol of
    its own that is greater than any byte. Sorted by the first ``length`` bytes: equal ranks mean equal strings of that
    length."""
    n = buf.size
    left = np.repeat(ends, ends - starts) - np.arange(n)
    short = np.minimum(left, 8)
    key = vec.loads(buf)[:n].byteswap()
    # bytes after the text's end are 0xFF, which no UTF-8 text holds
    key |= np.where(short < 8, (np.uint64(1) << ((8 - np.minimum(short, 7)) * 8 * (short < 8)).astype(np.uint64)) - np.uint64(1), np.uint64(0))
    order = np.argsort(key)
    ended = np.flatnonzero(left[order] < 8)  # equal ones lie together, and go by their texts
    order[ended] = order[ended][np.lexsort((order[ended], key[order[ended]]))]
    sorted_key = key[order]
    new = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | (left[order][1:] < 8) | (left[order][:-1] < 8)]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 8
    while done < length:
        step = min(done, length - done)
        size = np.bincount(rank, minlength=n)
        unsorted = np.flatnonzero((size[rank] > 1))
        if not unsorted.size:
            break
        # members of a group have at least ``done`` bytes left; what follows the text's end is unique by rank
        follow = np.minimum(unsorted + step, n - 1)
        second = np.where(left[unsorted] > step, rank[follow], n + unsorted)
        both = rank[unsorted] * (2 * n) + second
        by = np.argsort(both)
        at, both = unsorted[by], both[by]
        group = both // (2 * n)
        first = np.r_[True, group[1:] != group[:-1]]
        new = np.r_[True, both[1:] != both[:-1]]
        begin = np.maximum.accumulate(np.where(first, np.arange(at.size), 0))
        head = np.maximum.accumulate(np.where(new, np.arange(at.size), 0))
        rank[at] = group + head - begin
        done += step
    return np.argsort(rank), rank


def common_prefixes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of each suffix, the bytes in common with the one before it in the order, up to ``length``, by Kasai's method in step
    over all texts: the first ``counts`` suffixes of each. A suffix's prefix is at least its left neighbour's in the text less
    one; at ``length`` order among equals is arbitrary, so nothing is carried from there."""
    n = buf.size
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at8 = vec.loads(buf)
    end_of = np.repeat(ends, ends - starts)
    out = np.zeros(n, np.int64)
    carry = np.zeros(starts.size, np.int64)
    by_count = np.argsort(-counts, kind="stable")
    live = by_count
    for t in range(int(counts.max(initial=0))):
        live = live[: np.searchsorted(-counts[live], -t, "left")]
        i = starts[live] + t
        has = place[i] > 0
        j = np.where(has, order[np.maximum(place[i] - 1, 0)], i)
        most = np.where(has, np.minimum(np.minimum(end_of[i] - i, end_of[j] - j), length), 0)
        got = np.minimum(np.maximum(carry[live] - 1, 0), most)
        go = np.flatnonzero(got < most)
        while go.size:
            x = at8[i[go] + got[go]] ^ at8[j[go] + got[go]]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            got[go] = np.minimum(got[go] + same, most[go])
            go = go[(same == 8) & (got[go] < most[go])]
        out[i] = got
        carry[live] = np.where(got >= length, 0, got)
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each text, which of its windows (all start with ``length`` bytes left) occur elsewhere in the texts."""
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    counts = np.maximum(sizes - length + 1, 0)
    if not buf.size:
        return [np.zeros(0, bool) for _ in texts]
    order, _ = suffix_order(buf, starts, ends, length)
    whole = np.repeat(ends, sizes) - np.arange(buf.size) >= length
    prefix = common_prefixes(buf, starts, ends, counts, order, length)
    sorted_prefix = prefix[order]
    sorted_whole = whole[order]
    with_last = sorted_whole & (sorted_prefix >= length)
    with_next = np.r_[with_last[1:], False]
    marked = np.zeros(buf.size, bool)
    marked[order] = with_last | with_next
    return [marked[s : s + c] for s, c in zip(starts, counts, strict=True)]


def runs_of(marked: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last place of each run of true."""
    edge = np.diff(np.r_[0, marked.astype(np.int8), 0])
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _shard(table: pa.Table) -> pa.Table:
    """h, c and the runs of marked window starts, relative to the context."""
    texts = table["t"].to_pylist()
    marks = repeated_windows(texts)
    runs = [runs_of(x) for x in marks]
    return pa.table({"h": table["h"], "c": table["c"], "a": pa.array([r[0] for r in runs], pa.list_(pa.int32())), "b": pa.array([r[1] for r in runs], pa.list_(pa.int32()))})


def window_hashes(buf: np.ndarray, salt: int, length: int = LENGTH) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on, by doubling from 8 bytes. ``length`` is 8 at least."""
    n = max(buf.size - length + 1, 0)
    have = first = vec.mix(vec.loads(buf) ^ np.uint64(salt))
    size, left, done, out = 8, length // 8, 0, np.full(n, np.uint64(salt))
    while left:
        if left & 1:
            out = join_hash(out, have[done : done + n])
            done += size
        left >>= 1
        if left:
            have = join_hash(have[:-size], have[size:])
            size *= 2
    return join_hash(out, first[length - 8 : length - 8 + n])


def digests_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the window at each place."""
    return window_hashes(buf, 0x51), window_hashes(buf, 0xA7)


def flat_windows(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes and offsets, and of each window its text and its place in the bytes."""
    buf, offs = vec.flat(texts)
    counts = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    owner = np.repeat(np.arange(counts.size), counts)
    return buf, offs, owner, offs[:-1][owner] + np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)


RUN = "shard int, h long, part int, d1 binary, d2 binary, more binary"


def _run(table: pa.Table) -> pa.Table:
    """A shard's distinct windows, each once, as sorted runs of digests: a run for each anchor and range of digests, with a
    byte for each window that says whether it occurs in the shard more than once."""
    buf, offs, owner, at = flat_windows(table["t"])
    _, rank = suffix_order(buf, offs[:-1], offs[1:])
    by = np.argsort(rank[at], kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(rank[at[by]]) != 0])
    more = np.diff(np.r_[first, by.size]) > 1
    one = by[first]
    d1, d2 = (d[at[one]] for d in digests_of(buf))
    h, parts = table["h"].to_numpy()[owner[one]], table["parts"].to_numpy()[owner[one]].astype(np.uint64)
    part = ((d1 >> np.uint64(32)) * parts >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((d1, part, h))
    h, part, d1, d2, more = h[order], part[order], d1[order], d2[order], more[order].astype(np.uint8)
    begin = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
    cuts = list(zip(begin.tolist(), np.r_[begin[1:], h.size].tolist(), strict=True))
    blobs = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (d1, d2, more)]
    shard = pa.array(np.full(len(cuts), table["shard"][0].as_py(), np.int32))
    return pa.table({"shard": shard, "h": h[begin], "part": part[begin], "d1": blobs[0], "d2": blobs[1], "more": blobs[2]})


def find(d1: np.ndarray, d2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """By binary search, the place of each digest (x1, x2) among those sorted by d1; -1: not there."""
    lo, hi = np.searchsorted(d1, x1), np.searchsorted(d1, x1, "right")
    out = np.full(x1.size, -1, np.int64)
    some = np.flatnonzero(hi > lo)
    good = d2[lo[some]] == x2[some]
    out[some[good]] = lo[some[good]]
    for i in some[~good & (hi[some] - lo[some] > 1)]:  # different digests that share 64 bits
        for k in range(lo[i], hi[i]):
            if d2[k] == x2[i]:
                out[i] = k
    return out


def merge_two(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two runs of (d1, d2, whether it occurs more than once), sorted by d1: the smaller is looked up in the larger."""
    if a[0].size < b[0].size:
        a, b = b, a
    at = find(a[0], a[1], b[0], b[1])
    more = a[2].copy()
    more[at[at >= 0]] = 1
    rest = at < 0
    where = np.searchsorted(a[0], b[0][rest], "right")
    return tuple(np.insert(x, where, y[rest]) for x, y in zip((a[0], a[1], more), b, strict=True))


def _merge(table: pa.Table) -> pa.Table:
    """The shards' runs of an anchor and a range of digests, merged two by two. Of each run, the digests that occur more than
    once in all."""
    runs = [tuple(np.frombuffer(x, t) for x, t in zip(r, (np.uint64, np.uint64, np.uint8), strict=True)) for r in zip(*(table[c].to_pylist() for c in ("d1", "d2", "more")), strict=True)]
    merged = runs
    while len(merged) > 1:
        merged = [merge_two(*merged[i : i + 2]) if i + 1 < len(merged) else merged[i] for i in range(0, len(merged), 2)]
    met = merged[0][2] > 0
    d1, d2 = merged[0][0][met], merged[0][1][met]
    there = [find(d1, d2, r[0], r[1]) >= 0 for r in runs]
    blobs = [pa.array([r[k][t].tobytes() for r, t in zip(runs, there, strict=True)], pa.binary()) for k in (0, 1)]
    return pa.table({"shard": table["shard"], "d1": blobs[0], "d2": blobs[1]})


def _mark(table: pa.Table, met: pa.Table) -> pa.Table:
    """Of a shard's contexts, the runs of windows whose digests occur more than once."""
    buf, offs, owner, at = flat_windows(table["t"])
    m1, m2 = (np.frombuffer(b"".join(met[c].to_pylist()), np.uint64) for c in ("d1", "d2"))
    order = np.argsort(m1, kind="stable")
    d1, d2 = (d[at] for d in digests_of(buf))
    marked = find(m1[order], m2[order], d1, d2) >= 0
    bounds = np.searchsorted(owner, np.arange(table.num_rows + 1))
    runs = [runs_of(marked[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"h": table["h"], "c": table["c"], "a": pa.array([r[0] for r in runs], pa.list_(pa.int32())), "b": pa.array([r[1] for r in runs], pa.list_(pa.int32()))})


def removed_ranges(docs: DataFrame) -> DataFrame:
    """_row and the byte ranges [from, to) to remove, not merged. ``docs``: _row, text; equal _row means equal texts."""
    counts = anchor_rows(docs, True).groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    repeated = common.materialise(counts, "repeated-anchors")
    places = common.materialise(anchor_rows(docs, False).join(repeated, "h"), "anchor-places")
    contexts = places.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("_row", "lo", "hi")).alias("one"))
    contexts = common.materialise(contexts, "contexts")
    span = F.col("one.hi") - F.col("one.lo")
    stats = contexts.groupBy("h").agg(F.count("*").alias("m"), F.sum(span + 1).alias("w"))
    several = common.materialise(stats.where("m > 1").select("h", "m", F.ceil(F.col("w") / MERGE_ROWS).cast("int").alias("parts")), "several")
    whole = contexts.where("k > 1").select("h", "c", F.array(F.lit(0)).alias("a"), F.array(span).alias("b"))

    chosen = contexts.join(several, "h").select("h", "c", "m", "parts", F.col("one._row").alias("_row"), F.col("one.lo").alias("lo"), (span + LENGTH).alias("size"))
    chosen = common.materialise(chosen, "chosen")
    total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    # an anchor with too many contexts is dealt out over several shards
    spread = F.ceil(F.col("m") / SHARD_CONTEXTS)
    shard = F.pmod(F.xxhash64("h", F.when(spread > 1, F.pmod(F.xxhash64("c"), spread)).otherwise(0)), F.lit(shards * 4)).cast("int")
    binary = F.col("_text").cast("binary")
    source = docs.select(F.col("_row").alias("_doc"), F.col("text").alias("_text"))
    texts = chosen.join(source, F.col("_row") == F.col("_doc")).select(
        "h", "c", "parts", shard.alias("shard"), (spread > 1).alias("cut"), F.substring(binary, F.col("lo") + 1, F.col("size")).alias("t")
    )
    # rows that repeat an id and a text share a key
    texts = common.materialise(texts.dropDuplicates(["h", "c"]), "context-texts")
    tasks = min(shards, MOST_TASKS)
    by_shard = lambda df: df.repartition(tasks, "shard").groupBy("shard")
    marks = [whole, by_shard(texts.where("not cut").select("h", "c", "shard", "t")).applyInArrow(common.tidy(_shard), MARKS)]
    cut = texts.where("cut").select("h", "c", "parts", "shard", "t")
    if not cut.isEmpty():
        runs = common.materialise(by_shard(cut).applyInArrow(common.tidy(_run), RUN), "window-runs")
        met = common.materialise(runs.groupBy("h", "part").applyInArrow(common.tidy(_merge), "shard int, d1 binary, d2 binary"), "windows-met")
        marks.append(by_shard(cut).cogroup(by_shard(met.where(F.octet_length("d1") > 0))).applyInArrow(common.tidy(_mark), MARKS))
    found = marks[0]
    for x in marks[1:]:
        found = found.unionByName(x)
    found = common.materialise(found.where(F.size("a") > 0), "marks")
    hits = places.join(found, ["h", "c"])
    each = hits.select("_row", "lo", F.explode(F.arrays_zip("a", "b")).alias("r"))
    return each.select("_row", (F.col("lo") + F.col("r.a")).alias("from"), (F.col("lo") + F.col("r.b") + LENGTH).alias("to"))


def cut_out(text: bytes, pairs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, what is left."""
    kept, removed, spans, at = [], 0, 0, 0
    end = -1
    for a, b in sorted(pairs):
        b = min(b, len(text))
        if a > end:
            kept.append(text[at:a])
            spans += 1
            removed += b - a
            end = at = b
        elif b > end:
            removed += b - end
            end = at = b
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, and what is left if asked for."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), common.row_key(docs, F.col("doc_id"), text).alias("_row"))
    # a document's ranges are as many as its windows at most
    ranges = removed_ranges(rows.select("_row", "text")).groupBy("_row").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, pairs in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    removed, spans, kept = cut_out(data, [(x["from"], x["to"]) for x in pairs or ()])
                    out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_text else 4]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds) + 1])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(ranges, "_row", "left").select("doc_id", "text", "ranges").mapInArrow(common.tidy(run), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
