"""Fill-in-the-middle: the rank index against plain offsets, cuts against plain slicing, exact restoring."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxrill.llm import middles
from voxrill.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
LINES = re.compile(r"[^\n]*\n|[^\n]+")
PIECES = st.lists(st.sampled_from(["\n", "a", "é", "👍 ", "\r\n", "x" * 300, "<", "P>", "<S", "M>", "> ", "\x00"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_boundaries(text):
    ends = np.cumsum([0] + [len(line.encode()) for line in LINES.findall(text)])
    offsets = middles.boundaries(text.encode())
    assert offsets.tolist() == ends.tolist()
    index = middles.RankIndex.fit(offsets)
    assert index.at(np.arange(len(offsets))).tolist() == ends.tolist()
    assert (np.abs(index.predict(np.arange(len(offsets))) - offsets) <= middles.ERROR + 1).all()


def test_segments_are_few_on_regular_lines():
    """Even lines are one segment, steady ones few; jumps and very long lines still come out exactly."""
    rng = np.random.default_rng(1)
    even = np.arange(0, 10**6, 40)
    assert len(middles.RankIndex.fit(even).first) == 1
    steady = np.concatenate(([0], np.cumsum(rng.integers(30, 50, 20_000))))
    assert len(middles.RankIndex.fit(steady).first) < 300
    wild = np.concatenate(([0], np.cumsum(rng.choice([1, 2, 10**6], 5_000))))
    for offsets in (even, steady, wild):
        index = middles.RankIndex.fit(offsets)
        assert (index.at(np.arange(len(offsets))) == offsets).all() and index.rest.dtype == np.int8


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = LINES.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_rows():
    rng = random.Random(3)
    bits = ["\n", "a b ", "é", "👍", "<P", ">", "<S>", "<", "$1\\", "\r"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    return rows + [(None, "x\ny\nz"), (900, None), (901, ""), (902, "w" * 10**6 + "\n" + "v\n" * 50_000), (5, rows[5][1]), (-3, "one line")]


def test_transform(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, output int").repartition(3)
    for rate, spm in ((100, 50), (60, 20), (0, 50)):
        made = middles.transform(df, rate=rate, spm=spm).withColumn("back", middles.restore(F.col("output"), F.col("form"))).collect()
        got = sorted((repr(r._given.doc_id), r._given.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made)
        assert got == sorted((repr(i), t or "", *plain(i, t, rate, spm)) for i, t in rows)
        assert all(r.back == (r._given.text or "") for r in made)
    assert middles.transform(df.limit(0)).count() == 0


def test_kept_index(spark):
    """An index column gives every cut by column functions alone."""
    rows = [r for r in odd_rows() if len(r[1] or "") < 1000] + [(77, "".join("y" * (k % 90) + "\n" for k in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = middles.rank_index(df).select("_given", "index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("index.lines"))).alias("rank"))
    got = every.select("_given.text", "rank", middles.cut_at(F.col("index"), F.col("rank")).alias("cut")).collect()
    assert len(got) == sum(len(LINES.findall(t or "")) + 1 for _, t in rows)
    for r in got:
        assert r.cut == len("".join(LINES.findall(r.text or "")[:r["rank"]]).encode())


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in rows)
    assert sorted(tuple(r) for r in QUERIES["op13_middles"](spark, SF).collect()) == want
