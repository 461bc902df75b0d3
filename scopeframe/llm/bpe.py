"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Each merge rank has a bucket of the list positions at which it applies; a tree of
64-bit words tells which buckets hold anything, and find-first-set on one word a level gives the least rank. Merges leave
stale entries behind, which are skipped when they come up. A pre-token of n bytes takes O(n log n) time, so megabytes
without white space are no trouble.

Defined results: a null text is empty; an empty text has no ids, and its decoded bytes are empty; repeated rows give
repeated results; an empty table gives an empty result; ids are carried as they are, null included; no other column is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vec

#: A vocabulary over so many bytes is refused rather than broadcast.
MOST_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens of up to SHORT bytes are merged many at a time and remembered by the worker, REMEMBERED at most before a batch;
#: then the memory is emptied. Longer ones have a queue of their own.
SHORT, REMEMBERED = 64, 150_000
#: Texts are encoded in runs of so many bytes.
RUN_BYTES = 2 << 20
TRUE = np.ones(1, bool)


class RankBitmap:
    """The ranks whose buckets hold anything: a tree of 64-bit words."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        size = ranks
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> 6
            before = level[word]
            level[word] = before | 1 << (rank & 63)
            if before:
                return
            rank = word

    def drop(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return
            rank = word

    def least(self) -> int:
        """By find-first-set on one word a level; -1: none."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return -1
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank


class RankQueue:
    """Positions by rank, one by one: least rank first, and of one rank the leftmost."""

    def __init__(self, ranks: int):
        self.bitmap = RankBitmap(ranks)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.bitmap.add(rank)

    def pop(self) -> tuple[int, int] | None:
        rank = self.bitmap.least()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.bitmap.drop(rank)
        return rank, position


class BucketQueue:
    """Positions by rank, a whole bucket at a time."""

    def __init__(self, ranks: int):
        self.bitmap = RankBitmap(ranks)
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
        else:
            self.buckets[rank] = positions
            self.bitmap.add(rank)

    def put_each(self, ranks: list[int], positions: list[int]) -> None:
        buckets, fresh = self.buckets, []
        for rank, position in zip(ranks, positions, strict=True):
            bucket = buckets.get(rank)
            if bucket is not None:
                bucket.append(position)
            else:
                buckets[rank] = [position]
                fresh.append(rank)
        for rank in fresh:
            self.bitmap.add(rank)

    def take(self) -> tuple[int, list[int]] | None:
        rank = self.bitmap.least()
        if rank < 0:
            return None
        self.bitmap.drop(rank)
        return rank, self.buckets.pop(rank)


class Codec:
    """Encodes and decodes by a rank file's content and a pre-token pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.size = max(self.ranks.values(), default=0) + 1
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)
        self.known: dict[str, bytes] = {}
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        lengths = np.array([len(self.tokens.get(i, b"")) for i in range(self.size)])
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.content = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(self.size)), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks, queue, n = self.ranks, self.queue, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wanted = [-1] * n  # the rank that the part here and the next one merge at; -1: none, or the part is gone
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                wanted[i] = rank
                queue.push(rank, i)
        while (least := queue.pop()) is not None:
            rank, i = least
            if wanted[i] != rank:
                continue
            gone = after[i]
            wanted[gone] = -1
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]], -1)
                wanted[i] = rank
                if rank >= 0:
                    queue.push(rank, i)
            else:
                wanted[i] = -1
            if (left := before[i]) >= 0:
                rank = ranks.get(piece[left:end], -1)
                if rank != wanted[left]:
                    wanted[left] = rank
                    if rank >= 0:
                        queue.push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens not yet known; those that are too long to be remembered are returned."""
        short, data, long = [], [], {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append(piece)
                data.append(raw)
            else:
                long[piece] = np.array(self.merge(raw), "<u4").tobytes()
        if short:
            self.known.update(zip(short, merge_many(data, self.byte_ids, self.pairs, self.size), strict=True))
        return long

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, each as four bytes, little-endian."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [self.find(x) for x in texts]
        get, new = self.known.get, set()
        for x in found:
            ids = list(map(get, x))
            if None in ids:
                new.update([piece for piece, own in zip(x, ids, strict=True) if own is None])
        long = self.learn(new)
        take = self.known.__getitem__
        if not long:
            return [b"".join(map(take, x)) for x in found]
        return [b"".join([long[y] if y in long else take(y) for y in x]) for x in found]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        out = []
        every = np.frombuffer(ids, "<u4")
        for at in range(0, every.size, 1 << 18):
            part = every[at : at + (1 << 18)].astype(np.int64)
            size = self.lengths[part]
            total = np.cumsum(size)
            if size.size:
                out.append(self.content[np.repeat(self.begins[part] - total + size, size) + np.arange(total[-1])].tobytes())
        return b"".join(out)


class PairTable:
    """Rank of the concatenation of two tokens, for arrays of pairs; -1: no token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.r_[np.array(keys, np.int64)[order], np.iinfo(np.int64).max]
        self.values = np.r_[np.array(values, np.int64)[order], -1]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: PairTable, ranks: int) -> list[bytes]:
    """Ids of many short pre-tokens, as bytes, by one queue over all of them: what comes up is a whole bucket, of which the
    leftmost valid position of each pre-token is merged and the rest goes back."""
    sizes = np.array([len(x) for x in pieces])
    n = int(sizes.sum())
    owner = np.r_[np.repeat(np.arange(len(pieces)), sizes), -1]
    token = np.r_[byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], 0]
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = n
    wanted = np.full(n + 1, -1)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    wanted[inner] = pairs(token[inner], token[inner + 1])
    order = np.argsort(wanted[:n], kind="stable")
    order = order[np.searchsorted(wanted[order], 0) :]
    queue = BucketQueue(ranks)
    cuts = np.flatnonzero(np.diff(wanted[order])) + 1
    for run in np.split(order, cuts):
        if run.size:
            queue.put(int(wanted[run[0]]), run.tolist())
    while (least := queue.take()) is not None:
        rank, bucket = least
        at = np.array(bucket)
        at.sort()
        at = at[wanted[at] == rank]
        if not at.size:
            continue
        own = owner[at]
        same = own[1:] == own[:-1]
        if same.any():
            again = at[1:][same & (at[1:] != at[:-1])]  # a position may have been put here twice
            at = at[np.concatenate((TRUE, ~same))]
            if again.size:
                queue.put(rank, again.tolist())
        gone = after[at]
        end = after[gone]
        token[at], after[at], wanted[gone], wanted[at] = rank, end, -1, -1
        right = owner[end] == owner[at]
        i, k = at[right], end[right]
        before[k] = i
        left = before[at]
        inside = (left >= 0) & (owner[left] == owner[at])
        h = left[inside]
        both = np.concatenate((i, h))
        new = pairs(token[both], np.concatenate((token[k], np.full(h.size, rank))))
        wanted[both] = new
        some = new >= 0
        queue.put_each(new[some].tolist(), both[some].tolist())
    heads = np.zeros(n + 1, bool)  # the last byte of a part gives the next head
    heads[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    at = np.flatnonzero(heads)
    while at.size:
        at = after[at]
        at = at[(at < n) & ~heads[at]]
        heads[at] = True
    kept = np.flatnonzero(heads[:n])
    ids = token[kept].astype("<u4").tobytes()
    bounds = (np.searchsorted(owner[kept], np.arange(len(pieces) + 1)) * 4).tolist()
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path}: over {MOST_VOCABULARY_BYTES} bytes")
    return data


#: The last codec that a worker has built, which its next tasks use again.
_LAST: dict[tuple[bytes, str], Codec] = {}


def codec_of(rank_file: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Codec(rank_file, pattern)
    return _LAST[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for. One pass, no shuffle."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value, pattern)
        for batch in batches:
            _, offs = vec.flat(batch.column("text"))
            for at, to in vec.slices(offs, RUN_BYTES):
                part = batch.slice(at, to - at)
                every = codec.encode_many(part.column("text").to_pylist())
                n = [len(ids) // 4 for ids in every]
                ids_sha = [hashlib.sha256(ids).hexdigest() for ids in every]
                decoded_sha = [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in every]
                ids_out = [np.frombuffer(ids, "<u4").astype(np.int32) for ids in every] if with_ids else None
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(common.tidy(run), schema)


def production(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production(common.table(spark, sf_dir, "documents"))
