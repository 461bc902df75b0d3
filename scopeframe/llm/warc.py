"""WARC archives: written with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own. The index (file, offset, length, url, digest, page) is a table; a reader sorts the
selected records by file and offset, and joins neighbouring ranges into one read of bounded size.

Pages of equal payloads (SHA-1, XXH64 and length) are stored once: the page with the largest id holds the response, and
the others are revisit records that name it. Payloads under ``least_revisit`` bytes are always stored.

Defined results: a null html is an empty payload; a null url is an empty target; rows that repeat an id and a payload give
a record each, all of them responses if the id is the largest; a null id is smaller than all others; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Neighbouring ranges with a gap up to GAP bytes are read at once, up to MOST bytes a read.
GAP, MOST = 1 << 16, 4 << 20
#: A writer begins another file after so many bytes.
FILE_BYTES = 1 << 30
CRLF = b"\r\n"
INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def open_file(path: str, mode: str):
    """A file of the shared folder, by its URI. Local schemes are opened plainly, others by Arrow."""
    if path.startswith("file:") or "://" not in path:
        local = path.removeprefix("file:")
        local = "/" + local.lstrip("/") if path.startswith("file:") else local
        if mode == "wb":
            import os

            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


def record(page_id, url: str, payload: bytes | None, digest: str, payload_bytes: int, refers_to) -> bytes:
    """One record, not compressed. payload None: a revisit, whose block is the HTTP head alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % payload_bytes, b"", b""])
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if payload is None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's fields, its HTTP fields, and its payload."""
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != CRLF * 2:
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(CRLF * 2)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def plan_records(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """page_id, url, html, hex SHA-1, and the page that a revisit refers to. Groups are found on digests alone: a count and a
    maximum, which collapse before the shuffle; a large group's join is one that Spark can split."""
    key = ["_sha", "_xx", "_n"]
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"),
        F.sha1(payload).alias("_sha"), F.xxhash64(payload).alias("_xx"), F.octet_length(payload).cast("long").alias("_n"),
    )
    shared = rows.groupBy(*key).agg(F.max("page_id").alias("_first"), F.count("*").alias("_c")).where(F.col("_c") > 1)
    shared = common.materialise(shared.where(F.col("_n") >= least_revisit).drop("_c"), "payloads")
    return rows.join(shared, key, "left").select(
        "page_id", "url", "_n", F.col("_sha").alias("sha"),
        F.when(F.col("_first") != F.coalesce("page_id", F.col("_first") - 1), F.col("_first")).alias("refers_to"),
        F.when(~F.col("_first").eqNullSafe(F.col("page_id")) & F.col("_first").isNotNull(), F.lit(None)).otherwise(F.col("html")).alias("html"),
    )


def write(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write archives into the shared folder; the index. A file's name is new for each attempt, and the index names only the
    files of attempts that ended well, so a lost executor leaves at most a file that nothing refers to."""
    folder = common.fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for x in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = open_file(path, "wb")
                    digest = base32_of_hex(x["sha"])
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = z.compress(record(x["page_id"], x["url"], x["html"], digest, x["_n"], x["refers_to"])) + z.flush()
                    out.write(member)
                    rows.append((path, at, len(member), x["url"], digest, x["page_id"]))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "offset", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    return common.materialise(plan_records(pages, least_revisit).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int, int]]:
    """Coalesced reads of sorted (offset, length): first row, row after the last, start, end."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            out[-1] = (out[-1][0], i + 1, out[-1][2], max(out[-1][3], offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The selected records: fields, payload digest and size as read back. Range partitions on file and offset keep
    neighbours together, and a batch's ranges are coalesced, so memory is bounded by a batch's rows and MOST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        path, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows, out = batch.slice(at, 2000).to_pylist(), []
                while rows:
                    n = next((i for i, x in enumerate(rows) if x["file"] != rows[0]["file"]), len(rows))
                    mine, rows = rows[:n], rows[n:]
                    if path != mine[0]["file"]:
                        if source is not None:
                            source.close()
                        path, source = mine[0]["file"], open_file(mine[0]["file"], "rb")
                    for first, last, start, end in ranges([(x["offset"], x["length"]) for x in mine]):
                        source.seek(start)
                        data = source.read(end - start)
                        for x in mine[first:last]:
                            fields, http, payload = parse(zlib.decompress(data[x["offset"] - start : x["offset"] - start + x["length"]], 31))
                            kind = fields["WARC-Type"]
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{path}, offset {x['offset']}: the payload doesn't fit its digest")
                            page = fields.get("X-Page-ID") or None
                            refers = fields.get("X-Refers-To-Page")
                            out.append((page and int(page), int(http["Content-Length"]), digest, kind, refers and int(refers), x["url"], payload if with_payload else None))
                columns = list(zip(*out, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                keep = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)][:keep], names[:keep])
        if source is not None:
            source.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    dealt = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(common.table(spark, sf_dir, "pages"))).drop("url")


SQL = """
with p as (select page_id, coalesce(html, '') as x from pages),
g as (select x, max(page_id) as top from p group by x),
d as (select page_id, top, octet_length(encode(x)) as payload_bytes, sha1(x) as h from p join g using (x)),
b as (select *, [('0x' || substr(h, 1 + 10 * k, 10))::bigint for k in range(4)] as parts from d)
select page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31)::int, 1) for k in range(32)], 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from b
"""
