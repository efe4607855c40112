"""WARC archives: writing pages as segmented, chunked records and reading them back whole."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotlake.llm.common import remove_folder, sized_broadcast, small_batches
from annotlake.plans.durable import cut, shared_folder

SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 13
RECORDS_PER_FILE = 1000
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "record_id string, record_type string, uri string, digest string, refers_to string, "
    "origin_id string, segment long, total long, block binary"
)
PAYLOADS = "record_id string, copies long, payload binary, payload_digest string, whole boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """What chunked framing holds; None if it breaks off or isn't framing."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        try:
            size = int(framed[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(framed):
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(framed[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r"  # the writer's line end completes it


def _records_of(record_id: str, url: str | None, payload: bytes, sha: str, refers_to: str | None, size: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    url = "".join(c for c in url if c not in "\r\n") if url is not None else None
    common = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield _record("revisit", record_id, [*common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")], http)
        return
    block = http + chunked(payload)
    if len(block) <= size:
        yield _record("response", record_id, common, block)
        return
    last = -(-len(block) // size)
    for k in range(1, last + 1):
        fields = [("WARC-Segment-Number", k)]
        if k > 1:
            fields += [("WARC-Segment-Origin-ID", f"<{record_id}>")]
        if k == last:
            fields += [("WARC-Segment-Total-Length", len(block))]
        piece = block[(k - 1) * size : k * size]
        yield _record("response" if k == 1 else "continuation", record_id if k == 1 else f"{record_id}:{k}", (common if k == 1 else []) + fields, piece)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC 1.1 files below ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes that with the smallest
    page_id becomes the response and the others revisits of it. A block longer than
    ``segment_bytes`` is split into continuation records. A null html is an empty payload;
    a page without id is always a response; equal rows give equal records. Files hold at
    most ``RECORDS_PER_FILE`` records, so each can be read whole.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    )
    sha = F.sha1("payload")
    tag = F.hex(F.xxhash64("url", sha))
    rows = rows.withColumn("record_id", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), tag))
    slim = cut(rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes)).select(F.xxhash64("payload").alias("key"), sha.alias("sha"), "page_id", "record_id"))
    first = slim.groupBy("key", "sha").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1").select("key", "sha", F.col("first.page_id").alias("first"), F.col("first.record_id").alias("refers_to")))
    again = cut(slim.join(first, ["key", "sha"]).where("page_id <> first").select(F.col("record_id").alias("_id"), "refers_to").distinct())
    framed = rows.join(sized_broadcast(again), F.col("record_id") == F.col("_id"), "left").drop("_id")

    def frame(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out, held = [], 0
            for i in range(part.num_rows):
                record_id, url, refers_to = (part.column(c)[i].as_py() for c in ("record_id", "url", "refers_to"))
                payload = part.column("payload")[i].as_py()
                for record in _records_of(record_id, url, payload, digest(payload), refers_to, segment_bytes):
                    out.append(record)
                    held += len(record)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out, held = [], 0
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    records = framed.select("record_id", "url", "refers_to", "payload").mapInArrow(frame, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).option("compression", "gzip").text(path)


def _parsed(content: bytes) -> Iterator[dict]:
    """Records of one archive, by their stated lengths."""
    if content[:2] == b"\x1f\x8b":
        plain = []
        while content:  # one member a file or one a record
            member = zlib.decompressobj(31)
            plain.append(member.decompress(content))
            content = member.unused_data
        content = b"".join(plain)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            return
        fields = {}
        for line in content[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = int(fields.get("content-length", 0))
        bare = lambda k: fields[k].strip("<>") if k in fields else None
        count = lambda k: int(fields[k]) if k in fields else None
        yield {
            "record_id": bare("warc-record-id"),
            "record_type": fields.get("warc-type"),
            "uri": fields.get("warc-target-uri"),
            "digest": fields["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in fields else None,
            "refers_to": bare("warc-refers-to"),
            "origin_id": bare("warc-segment-origin-id"),
            "segment": count("warc-segment-number"),
            "total": count("warc-segment-total-length"),
            "block": content[head + 4 : head + 4 + size],
        }
        at = head + 4 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, gzipped or plain, one row each."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                out, held = [], 0
                for row in _parsed(part.column("content")[i].as_py()):
                    out.append(row)
                    held += len(row["block"])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORDS)


_ARROW = pa.schema(
    [(k, pa.string()) for k in ("record_id", "record_type", "uri", "digest", "refers_to", "origin_id")]
    + [("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())]
)


def read_payloads(records: DataFrame) -> DataFrame:
    """``record_id, copies, payload, payload_digest, whole`` of every response.

    Segments are grouped by the identifier of the record they continue, ordered by number
    and joined; ``whole`` is false, and the payload null, where a number is missing, the
    stated total length is not met, the chunked framing breaks off or the stated digest
    differs. Records that occur several times come back once with their number as ``copies``.
    """
    parts = records.where(F.col("record_type").isin("response", "continuation"))
    alone = F.col("segment").isNull()
    one = parts.where(alone).select(
        "record_id", F.lit(1).cast("long").alias("copies"), "digest", F.octet_length("block").cast("long").alias("total"), F.array("block").alias("blocks"), F.lit(True).alias("complete")
    )
    split = parts.where(~alone).withColumn("origin", F.coalesce("origin_id", "record_id"))
    many = (
        split.groupBy("origin", "segment")
        .agg(F.count(F.lit(1)).alias("n"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.first("block").alias("block"))
        .groupBy("origin")
        .agg(
            F.max(F.when(F.col("segment") == 1, F.col("n"))).alias("copies"),
            F.max("digest").alias("digest"),
            F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
            F.max("segment").alias("last"),
            F.count(F.lit(1)).alias("got"),
        )
        .where("copies is not null")
        .select(F.col("origin").alias("record_id"), "copies", "digest", "total", F.col("s.block").alias("blocks"), (F.col("last") == F.col("got")).alias("complete"))
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, copies, stated, totals, complete = (part.column(c).to_pylist() for c in ("record_id", "copies", "digest", "total", "complete"))
            payloads, digests = [], []
            for i in range(part.num_rows):
                block = b"".join(part.column("blocks")[i].as_py())
                head, _, rest = block.partition(b"\r\n\r\n")
                good = complete[i] and (totals[i] is None or totals[i] == len(block))
                payload = (dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest) if good else None
                sha = digest(payload) if payload is not None else None
                if sha is None or stated[i] not in (None, sha):
                    payload = sha = None
                payloads.append(payload)
                digests.append(sha)
            yield pa.RecordBatch.from_pydict(
                {
                    "record_id": pa.array(ids, pa.string()),
                    "copies": pa.array(copies, pa.int64()),
                    "payload": pa.array(payloads, pa.binary()),
                    "payload_digest": pa.array(digests, pa.string()),
                    "whole": pa.array([x is not None for x in payloads], pa.bool_()),
                }
            )

    cols = ["record_id", "copies", "digest", "total", "blocks", "complete"]
    return one.select(*cols).unionByName(many.select(*cols)).mapInArrow(decode, PAYLOADS)


def page_of(record_id: str):
    """The page_id in a record identifier made by ``write_warc``; null for a page without one."""
    return F.expr(f"try_cast(split({record_id}, ':')[2] as bigint)")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the session's shared folder, read them back and describe each page.

    One row a page: ``page_id, payload_bytes, payload_digest`` (of the full payload, which a
    revisit takes from the response it refers to), ``record_type, refers_to, whole``. The
    archives are removed once the description is written.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes)
    records = read_records(spark, path)
    payloads = cut(read_payloads(records).select("record_id", "copies", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "whole"))
    revisits = cut(records.where("record_type = 'revisit'").select("record_id", "refers_to"))
    remove_folder(spark, path)
    responses = payloads.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        "whole",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
    origin = cut(
        payloads.groupBy(F.col("record_id").alias("refers_to")).agg(
            F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"), F.min("whole").alias("whole")
        )
    )
    again = revisits.join(origin, "refers_to", "left").select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.lit("revisit").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
        F.coalesce("whole", F.lit(False)).alias("whole"),
    )
    return responses.unionByName(again)
