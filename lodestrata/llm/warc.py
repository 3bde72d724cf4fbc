"""WARC archives as tables of chunks.

An archive is a table in the shared folder: (archive, record_no, chunk_no, last, data).  The data of an archive, in the
order of record_no and chunk_no, are a WARC/1.1 file byte for byte.  A payload over CHUNK bytes is streamed as several
rows, so neither writer nor reader ever builds a whole oversized record: the reader gets the rows of an oversized record
in chunk order and carries one SHA-1 state and one byte count from row to row.  Its own result is again a chunk table in
which every row has the digest and length of the payload up to its end; the row marked `last` describes the record.

Payloads stay where they are: only repeated digests travel, to every task while they are few, and beyond that pages meet them
by digest, those of digests with very many copies by broadcast.  A revisit is verified against the response it names.

Cases: a null payload is an empty one.  Of equal payloads the record with the largest page_id is a response and the
others are revisits of it; rows that repeat that page_id are responses as well; a null page_id is below every other, and
where all are null each is a response.  An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written

CHUNK = 1 << 16
_BASE = "archive int, record_no bigint, chunk_no int, chunks int, last boolean, data binary"
_READ = "page_id bigint, record_type string, refers_to bigint, chunk_no int, last boolean, bytes_so_far bigint, digest_so_far string, payload_bytes bigint, payload_digest string, digest_ok boolean, target_uri string"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


#: Repeated digests that may be sent to every task, and the copies of one from which it is never a key of a shuffle.
BROADCAST_ROWS, HOT_COPIES = 300_000, 10_000


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the page that an equal payload's response has, null for responses."""
    pages = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    repeated = written(pages.groupBy("_sha").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).where("_n > 1 and _top is not null"))
    own = F.when(~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top"))
    if repeated.count() <= BROADCAST_ROWS:
        met = pages.join(F.broadcast(repeated), "_sha", "left")
    else:
        hot = repeated.where(F.col("_n") >= HOT_COPIES).select("_sha", F.col("_top").alias("_hot"))
        if hot.count() <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        # pages of hot digests are spread by their own ids
        key = F.when(F.col("_hot").isNull(), F.col("_sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
        met = pages.join(hot, "_sha", "left").withColumn("_sha", key).join(repeated.drop("_n"), "_sha", "left").withColumn("_top", F.coalesce("_hot", "_top"))
    return met.select("page_id", "url", "html", own.alias("refers_to"))


def record_head(page_id, url, digest: str, size: int, refers_to) -> bytes:
    """Header of a WARC record with its blank line; a revisit has an empty block."""
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "2020-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(HTTP) + size if refers_to is None else 0)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def write(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """pages (page_id, url, html, refers_to) as an archive table, written to the shared folder and read again."""
    from pyspark import TaskContext

    names = ["archive", "record_no", "chunk_no", "chunks", "last", "data"]
    kinds = pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        archive, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                payload = memoryview(html.as_buffer())
                refers = refers_to.as_py()
                head = record_head(page_id.as_py(), url.as_py(), base32_sha1(hashlib.sha1(payload).digest()), len(payload), refers)
                if refers is not None:
                    rows.append((archive, number, 0, 1, True, head + b"\r\n\r\n"))
                else:
                    n = max(1, -(-len(payload) // chunk))
                    for i in range(n):
                        data = bytes(payload[i * chunk : (i + 1) * chunk])
                        data = (head + HTTP if not i else b"") + data + (b"\r\n\r\n" if i == n - 1 else b"")
                        rows.append((archive, number, i, n, i == n - 1, data))
                        held += len(data)
                        if held > 1 << 23:
                            yield pack(rows)
                            rows, held = [], 0
                number += 1
            if rows:
                yield pack(rows)

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, _BASE))


def _head(data: bytes) -> tuple[dict, int]:
    """Named fields of a record's header, and where its block begins."""
    end = data.index(b"\r\n\r\n") + 4
    lines = data[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line), end


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def read_chunks(archive: DataFrame) -> DataFrame:
    """A row for each chunk of each record, with the payload's digest and length up to that chunk's end."""
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()

    def run(batches):
        head, state, size, key = {}, None, 0, None
        for batch in batches:
            rows = []
            for archive, number, chunk_no, last, data in zip(*(batch.column(n) for n in ("archive", "record_no", "chunk_no", "last", "data"))):
                data, i, end = data.as_py(), chunk_no.as_py(), last.as_py()
                if i == 0:
                    head, at = _head(data)
                    key, state, size = (archive.as_py(), number.as_py()), hashlib.sha1(), 0
                    if head["WARC-Type"] == "response":
                        at = data.index(b"\r\n\r\n", at) + 4
                else:
                    at = 0
                    if (archive.as_py(), number.as_py()) != key:
                        raise ValueError("chunks of a record are out of order")
                part = memoryview(data)[at : len(data) - 4 if end else None]
                state.update(part)
                size += len(part)
                so_far, told = base32_sha1(state.digest()), head["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = head["WARC-Type"] == "revisit"
                ok = (revisit or so_far == told and size == int(head["X-Payload-Length"])) if end else None
                rows.append((
                    _page(head["WARC-Record-ID"]), head["WARC-Type"], _page(head.get("WARC-Refers-To")), i, end, size, so_far,
                    int(head["X-Payload-Length"]) if revisit else size, told if revisit else so_far, ok, head.get("WARC-Target-URI"),
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    fields = ["archive", "record_no", "chunk_no", "chunks", "last", "data"]
    whole = archive.select(*fields).where("chunks = 1")
    cut = archive.select(*fields).where("chunks > 1").repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return whole.mapInArrow(run, _READ).unionByName(cut.mapInArrow(run, _READ))


def records(chunks: DataFrame) -> DataFrame:
    """A row for each record, taken from its last chunk, which carries the digest of all.

    digest_ok: for a response whether its payload is what its header says; for a revisit whether the page it names has such a
    response, with the digest that the revisit gives.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "target_uri"]
    last = written(chunks.where("last").select(*names))
    named = last.where("refers_to is not null").select("refers_to", "payload_digest", "payload_bytes").distinct()
    responses = last.where("record_type = 'response' and digest_ok").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = named.join(responses, ["refers_to", "payload_digest", "payload_bytes"]).withColumn("_found", F.lit(True))
    found = written(found)
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    ok = F.when(F.col("record_type") == "revisit", F.coalesce("_found", F.lit(False))).otherwise(F.col("digest_ok"))
    return last.join(found, ["refers_to", "payload_digest", "payload_bytes"], "left").withColumn("digest_ok", ok).select(*names)
