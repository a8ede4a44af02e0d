"""Archives: round trip through files, types of records, and the format itself."""

import base64
import glob
import hashlib
import struct

import zstandard
from pyspark.sql import types as T

from voxrill.llm import archive

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.IntegerType())])
ROWS = (
    [(i, f"http://a/{i}", f"<p>page {i % 7} é</p>" * (i % 7), 0) for i in range(50)]
    + [(100, None, None, 1), (101, "x\r\ny", "", 1), (102, "u", "z" * 300_000, 1), (None, "n", "only here", 1), (None, "m", "<p>page 3 é</p>" * 3, 1)]
    + [(200, "r", "twice told", 1), (200, "r", "twice told", 1)]
)


def wanted(min_bytes):
    top = {}
    for i, _, html, _ in ROWS:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html, _ in ROWS:
        raw = (html or "").encode()
        best = None if top[html or ""] == -1 else top[html or ""]
        revisit = len(raw) >= min_bytes and i != best
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, files):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for min_bytes in (0, 40):
        path = f"{files}/warc{min_bytes}"
        archive.write_archives(df, path, min_bytes)
        got = [tuple(r) for r in archive.read_archives(spark, path).collect()]
        assert sorted(got, key=str) == wanted(min_bytes)


def test_files_are_plain_zstandard(spark, files):
    path = f"{files}/plain"
    archive.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path, 0)
    name = max(glob.glob(f"{path}/part-*"), key=lambda f: len(open(f, "rb").read()))
    data = open(name, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == archive.DICTIONARY_MAGIC
    whole = zstandard.ZstdCompressionDict(data[8:8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=whole).stream_reader(data[8 + size:], read_across_frames=True)
    assert reader.read() == b"".join(archive.read_records(data))
    fields, block = archive.parse(next(archive.read_records(data)))
    assert fields["WARC-Block-Digest"] == "sha1:" + archive.payload_digest(block)


def test_no_pages(spark, files):
    path = f"{files}/none"
    archive.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert archive.read_archives(spark, path).count() == 0


def test_frames_of_few_and_of_many_records():
    for records in ([], [b"WARC/1.1\r\n\r\n"], [b"record %d " % i * 50 for i in range(2000)]):
        data = b"".join(f + archive.EMPTY_FRAME.encode() for f in archive.frames(iter(records)))
        assert list(archive.read_records(data)) == records
