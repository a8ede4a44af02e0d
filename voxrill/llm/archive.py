"""WARC archives compressed record by record with a dictionary of their own.

A task writes one archive. It reads ahead a bounded number of bytes, builds a Zstandard dictionary from
those records, puts the dictionary in a leading skippable frame, and then compresses each record as a
frame of its own, so that single records can be read. Spark's text sink writes the frames: it puts the
bytes of a string column down as they are, and its separator is an empty skippable frame, which every
Zstandard reader passes over. Archives so go to any file system that Spark knows, and failed attempts
leave nothing behind.

Of rows with equal payloads the one with the largest id is the response and the others are revisits of it;
rows with a null id count as smallest. Rows equal in id and payload are one record told twice and share a
type. Payloads below ``min_bytes`` are never revisited. A null payload is empty; an empty table gives an
archive without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.registry import query
from voxrill.session import shared_folder

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes read ahead for the dictionary, and its size.
READ_AHEAD = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str, digest: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    target = "".join(c for c in (url or "about:blank") if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; where they are too few to train on, the records themselves."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary's frame, then one frame for each record."""
    ahead, size = [], 0
    for r in records:
        ahead.append(r)
        size += len(r)
        if size >= READ_AHEAD:
            break
    trained = _dictionary(ahead)
    raw = trained.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    for r in ahead:
        yield packer.compress(r)
    del ahead
    for r in records:
        yield packer.compress(r)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends."""
    magic = struct.unpack_from("<I", data, at)[0]
    if 0x184D2A50 <= magic <= 0x184D2A5F:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    head = data[at:at + 18]
    end = at + zstandard.frame_header_size(head)
    while True:
        field = int.from_bytes(data[end:end + 3], "little")
        end += 3 + (1 if (field >> 1) & 3 == 1 else field >> 3)
        if field & 1:
            break
    return end + (4 if zstandard.get_frame_parameters(head).has_checksum else 0)


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive's bytes."""
    view, at, unpacker = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = _frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = bytes(view[8:end])
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        elif not 0x184D2A50 <= magic <= 0x184D2A5F:
            yield unpacker.decompress(bytes(view[at:end]))
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page_id(record_id: str) -> int | None:
    text = record_id.split(":")[2]
    return None if text == "none" else int(text)


def _split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), payload


def typed(pages: DataFrame, min_bytes: int, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) of every row."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), common.body(pages, payload_col).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    # Aggregated before it moves, and dealt anew, so that a payload with very many copies can be split.
    # "other" is a flag of its own: the largest id may be null.
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("largest")).hint("rebalance")
    is_revisit = (F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(largest, "digest").select("page_id", "url", "payload", "largest", is_revisit.alias("revisit"))


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: dt.datetime = dt.datetime(2020, 1, 1),
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> None:
    """Write ``pages`` as archives below ``path``, one for each partition."""
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page, url, payload, largest, revisit in zip(*batch.columns):
                body = payload.as_py()
                yield record(page.as_py(), url.as_py(), body, largest.as_py(), revisit.as_py(), stamp, payload_digest(body))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for frame in frames(rows(batches)):
            held.append(frame)
            size += len(frame)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    found = typed(pages, min_bytes, id_col, url_col, payload_col).mapInArrow(write, "frame binary")
    found.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, as RECORDS; digests and sizes are of the full payload."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for content in batch.column(0):
            for raw in read_records(content.as_py()):
                fields, block = parse(raw)
                http, payload = _split_http(block)
                revisit = fields["WARC-Type"] == "revisit"
                if revisit:
                    size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                else:
                    size, digest = len(payload), payload_digest(payload)
                refers = _page_id(fields["WARC-Refers-To"]) if revisit else None
                for x, v in zip(out, (_page_id(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers)):
                    x.append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(common.by_batch(read), RECORDS)


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT html, max(page_id) AS top FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN m USING (html)
""")
def op8_warc(spark, d):
    """Every page as a record of an archive, as read back from the archives."""
    path = shared_folder(spark, "archives")
    write_archives(common.table(spark, d, "pages"), path, min_bytes=0)
    return read_archives(spark, path)
