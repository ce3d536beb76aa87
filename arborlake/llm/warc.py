"""WARC archives: one gzip member per record, an index written first-hand with them, and
reads of chosen records by sorted, coalesced byte ranges.

The index holds file, offset, length, URL and digest of every record, so a selection
(by URL, digest or page) touches no archive bytes but its own.

Defined results: a null payload is an empty one; a null URL has no target header and reads back as
null, one with line breaks or blanks at its ends is also written percent-encoded and reads back as it was; of equal payloads the record with the smallest page_id is the response
(repeated rows of that page_id are responses too); rows with a null page_id refer to a
page that has one, or are responses if none has; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.shared import rows_as, shared_dir, shuffle_parts, written
from arborlake.llm.text import pieces
from arborlake.llm.token_files import read_ranges

_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
INDEX = "page_id long, url string, digest string, file string, at long, size long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.large_binary())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the full payload but no body."""
    body = b"" if refers_to is not None else payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        plain = "".join(url.splitlines()).strip()
        lines.append("WARC-Target-URI: " + plain)
        if plain != url:
            lines.append("X-Target-URI: " + quote(url, safe=""))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of one record; raises ValueError if a response differs from its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    page = lambda x: int(x[len("<urn:page:") : -1]) if x not in (None, "<urn:page:>") else None
    kind, body, digest = fields["warc-type"], rest[: int(fields["content-length"])], fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(fields["x-payload-length"])
    if not lines[0].startswith("WARC/") or kind == "response" and (len(body) != size or digest_of(body) != digest):
        raise ValueError("damaged record")
    return {"page_id": page(fields["warc-record-id"]), "url": unquote(fields["x-target-uri"]) if "x-target-uri" in fields else fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "payload": body if kind == "response" else None}


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: the page that first holds the payload.

    Only (digest, smallest page_id) is aggregated, with map-side sums, and only for digests
    that occur twice; so one payload that a third of the pages share costs a row a task.
    """
    sized = pages.withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    first = sized.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = sized.join(first, "sha", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))).drop("sha", "first")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one archive per task below ``folder`` and returns the index."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, ""
        try:
            for part, payloads in pieces(batches, "html"):
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    name = f"{path}/pages-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                ids, urls = part.column("page_id").to_pylist(), part.column("url").to_pylist()
                offsets, sizes = [], []
                for page_id, url, payload, refers_to in zip(ids, urls, payloads, part.column("refers_to").to_pylist(), strict=True):
                    member = gzip.compress(record(page_id, url, payload, refers_to, date), 3, mtime=0)
                    out.write(member)
                    offsets.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield rows_as({"page_id": ids, "url": urls, "digest": [digest_of(p) for p in payloads], "file": [name] * len(ids), "at": offsets, "size": sizes}, _INDEX)
        finally:
            if out is not None:
                out.close()

    return written(revisits(rows, min_bytes).mapInArrow(write, INDEX))


def read_warc(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, if asked, payload (null for a revisit).
    """
    wanted = pa.schema([f for f in _RECORD if with_payload or f.name != "payload"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in read_ranges(batches, folder):
            rows = [parsed(gzip.decompress(m)) for m in members]
            yield rows_as({f.name: [r[f.name] for r in rows] for f in wanted}, wanted)

    dealt = index.select("file", "at", "size").repartitionByRange(shuffle_parts(index), "file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else ""))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages and reads the archives back, without the payloads."""
    folder = shared_dir(spark)
    return read_warc(write_warc(pages, folder, min_bytes=min_bytes), folder, with_payload=False)
