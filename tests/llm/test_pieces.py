"""Encoding and decoding against the library, on drawn texts and through Spark."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxrill.llm import pieces

sp = pytest.importorskip("sentencepiece")
lib = sp.SentencePieceProcessor(model_file=pieces.default_model())
with open(pieces.default_model(), "rb") as f:
    coder = pieces.Coder(f.read())

fragments = st.sampled_from(["a", "th", "on", " ", "   ", "▁", "\n", "\t", "é", "日", "0", ".", "ing", "<0x0A>", "</s>", "ß", "\x00", "👍", "①", "(", "_"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(fragments, max_size=30).map("".join)))
def test_same_as_library(text):
    ids = lib.encode(text, add_eos=True)
    assert [*coder.encode(text), coder.end_id] == ids
    assert coder.decode(ids) == lib.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=10))
def test_decodes_any_ids(ids):
    assert coder.decode(ids) == lib.decode(ids)


def test_long_text_without_spaces():
    text = "thonre" * 20_000 + "日本" * 500
    assert coder.encode(text) == lib.encode(text)


def test_edge_rows(spark):
    texts = [None, "", " ", "Same words.", "Same words.", "ü" * 5000]
    df = spark.createDataFrame([(i if i != 4 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = pieces.digests(df, pieces.default_model()).collect()
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for t in texts:
        ids = lib.encode(t or "", add_eos=True)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.digests(df.limit(0), pieces.default_model()).count() == 0


def test_columns_round_trip(spark):
    df = spark.createDataFrame([("one two",), (None,)], "text string")
    ids = df.select("text", pieces.encode_column(spark, df.text, pieces.default_model()).alias("ids"))
    back = ids.select("text", "ids", pieces.decode_column(spark, ids.ids, pieces.default_model()).alias("back")).collect()
    assert {(r.text, r.back) for r in back} == {("one two", "one two"), (None, "")}
    assert all(r.ids[-1] == 2 for r in back)
