"""WARC archives with segmented records and chunked payloads: writing, reading back, reassembling."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, small_batches, text_of

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# A record's block has at most so many bytes, a file at most so many records: a file is read by one task.
SEGMENT_BYTES = 1 << 14
FILE_RECORDS = 1 << 10
CHUNK_BYTES = 1 << 12


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{payload_digest}')}>"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16) if line > at else -1
        start, end = line + 2, line + 2 + size
        if size < 0 or (size and body[end : end + 2] != b"\r\n"):
            raise ValueError("broken chunk")
        if not size:
            return b"".join(out)
        out.append(body[start:end])
        at = end + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the last line feed, which the writer of lines adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"%b\r\n%b\r\n%b\r\n\r" % (VERSION, head.encode(), block)


def records_of(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response in as many segments as it needs."""
    mark, length = digest(payload), len(payload)
    own = record_id(page_id, mark)
    target = re.sub(r"[\r\n]+", " ", url or "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{mark}"), ("Content-Type", "application/http;msgtype=response")]
    names = [] if page_id is None else [("X-Page-ID", str(page_id))]
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % length
        headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id(refers_to, mark)), ("WARC-Profile", REVISIT_PROFILE)]
        names.append(("X-Refers-To-Page-ID", str(refers_to)))
        yield _record(headers + common + names, block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for number, part in enumerate(parts, 1):
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", own)] if number == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{page_id}#{number}", mark)), ("WARC-Segment-Origin-ID", own)]
        if len(parts) > 1:
            headers.append(("WARC-Segment-Number", str(number)))
        if len(parts) == number > 1:
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(headers + (common + names if number == 1 else common[:2]), part)


def write(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, file_records: int = FILE_RECORDS
) -> None:
    """Write a record per row of ``pages`` to compressed archives below ``path``.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads the one
    with the largest page_id is written as response, the others as revisits of it; rows
    that repeat page_id and payload are responses alike, and a null page_id is the
    smallest. Responses are in chunked framing and split into records of at most
    ``segment`` bytes.
    """
    small_batches(pages.sparkSession)
    keyed = pages.select(
        F.col(page_id).cast("string").alias("own"), F.col(page_id).alias("rank"), F.col(url).alias("url"), text_of(html).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = keep(keyed.groupBy("sha").agg(F.max("rank").cast("string").alias("first")), "responses")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = (r for row in batch.itertuples(index=False) for r in one(*(None if pd.isna(x) else x for x in row)))
            while some := list(islice(found, 256)):
                yield pd.DataFrame({"record": some})

    def one(own: str | None, target: str | None, payload: bytes, refers: str | None) -> Iterator[bytes]:
        return records_of(own, target, payload, refers, own != refers, segment, chunk)

    lines = keyed.join(first, "sha").select("own", "url", "payload", "first").mapInPandas(records, "record binary")
    text = lines.select(F.col("record").cast("string").alias("value"))  # the bytes stay as they are
    text.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or head_end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:head_end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = head_end + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[start:end]
        at = end + 4


def _row(h: dict[str, str], block: bytes) -> tuple:
    number, total = (h.get(f"warc-segment-{x}") for x in ("number", "total-length"))
    mark = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (
        h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), mark, h.get("x-page-id"), h.get("x-refers-to-page-id"),
        h.get("warc-segment-origin-id"), number and int(number), total and int(total), block,
    )


RECORD = "record_id string, type string, url string, digest string, page_id string, refers_to string, origin string, number int, total long, block binary"
_COLUMNS = [field.split()[0] for field in RECORD.split(", ")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``. A task reads a file at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = (_row(h, block) for h, block in parse(gzip.decompress(content)))
                while some := list(islice(found, 256)):
                    yield pd.DataFrame(some, columns=_COLUMNS, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(rows, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: ``records`` with the segments of each origin joined, plus ``segments`` and ``complete``.

    Continuations are grouped by the identifier of their origin and put in order of
    their segment number. ``complete`` is false where numbers are missing or repeat with
    other bytes, or where the length differs from the total that the last segment
    gives; the block then holds what there is. A record that was archived several times
    comes as often as its first segment (once if that is missing). Records that were
    never cut are not shuffled.
    """
    whole = records.where("number IS NULL").select(*_WHOLE, F.lit(1).alias("segments"), F.lit(True).alias("complete"))
    head = F.when(F.col("number") == 1, F.struct("type", "url", "digest", "page_id", "refers_to"))
    # Text holds any bytes; sets of it combine before the exchange, so copies cost nothing.
    piece = F.struct("number", F.col("block").cast("string").alias("block"))
    parts = (
        records.where("number IS NOT NULL")
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(
            F.array_sort(F.collect_set(piece)).alias("pieces"), F.max(head).alias("head"), F.max("total").alias("total"),
            F.count_if(F.col("number") == 1).cast("int").alias("copies"),
        )
    )
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    in_order = F.transform("pieces", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("pieces"))
    joined = parts.select(
        "record_id", "head.*", F.array_join(F.transform("pieces", lambda p: p["block"]), "").cast("binary").alias("block"),
        F.size("pieces").alias("segments"), (in_order & (length == F.coalesce("total", F.lit(-1)))).alias("complete"),
        F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"),
    )
    return whole.unionByName(joined.drop("copy"))


_WHOLE = ["record_id", "type", "url", "digest", "page_id", "refers_to", "block"]
_PAYLOAD = "payload binary, length long, digest string, valid boolean"


def payload_of(block: bytes, stated: str | None, revisit: bool) -> tuple[bytes | None, int | None, str | None, bool]:
    """(payload, its length, its digest, whether both agree with what the record states) of an HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if revisit:
        return None, int(fields[b"content-length"]), stated, True
    try:
        payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError:
        return None, None, stated, False
    found = digest(payload)
    return payload, len(payload), found, found == stated


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives below ``path``.

    (page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, valid).
    A revisit has no payload of its own: length and digest are those it states for the
    payload of the response it refers to. ``valid`` is false for a record with missing
    segments, broken framing or another digest than it states.
    """

    @F.pandas_udf(_PAYLOAD)
    def decode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blocks, stated, kinds in batches:
            rows = [payload_of(b, s, k == "revisit") for b, s, k in zip(blocks, stated, kinds, strict=True)]
            yield pd.DataFrame(rows, columns=["payload", "length", "digest", "valid"], dtype=object)

    small_batches(spark)
    whole = reassemble(read_records(spark, path))
    return whole.withColumn("found", decode("block", "digest", "type")).select(
        "page_id", "url", F.col("type").alias("record_type"), "refers_to", "found.payload", F.col("found.length").alias("payload_bytes"),
        F.col("found.digest").alias("payload_digest"), (F.col("complete") & F.col("found.valid")).alias("valid"),
    )
