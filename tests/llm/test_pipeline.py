"""The pipeline, stage by stage, against plain versions of each stage."""

import collections
import hashlib

import pytest

import corpus_pipeline
from tests.llm.test_linededup import brute as plain_lines
from voxrill.llm import mixing, pieces, simhash, toxicity
from voxrill.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], SF)))
    return docs


def test_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "mixing", "encoding"]
    assert all(d.dtypes == steps[0].dtypes for d in steps[:-1])


def test_toxicity(spark, steps):
    g = toxicity.train_for(spark, steps[0], SF)
    want = {r.doc_id for r in steps[0].collect() if g.score(r.text or "") < corpus_pipeline.TOXIC}
    assert {r.doc_id for r in steps[1].collect()} == want and len(want) < steps[0].count()


def test_lines(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    got = steps[2].collect()
    assert sorted((r.doc_id, r.text) for r in got) == plain_lines(rows, corpus_pipeline.LINE_DOCS, 1, "first")
    assert all(r.n_chars == len(r.text) for r in got)


def test_mixing(steps):
    want = {r.doc_id: len(r.shards) for r in mixing.takes(steps[3]).collect()}
    got = collections.Counter(r.doc_id for r in steps[4].collect())
    assert got == +collections.Counter(want)


def test_encoding(steps):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())
    text = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        ids = lib.encode(text[r.doc_id], add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_run(spark, steps):
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, steps[-1].collect()))


def test_a_line_of_two_documents_stays_in_the_first(spark):
    rows = [(1, "own one\nShared", 0), (2, "shared \nown two", 0), (3, "own three", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = corpus_pipeline.drop_shared_lines(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(1, "own one\nShared", 14), (2, "own two", 7), (3, "own three", 9)]


def test_near_copies_by_similarity(steps):
    """Of texts that an exact Jaccard similarity of 0.8 or more joins up, one stays; all others stay."""
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1].lower().split() == rows[j][1].lower().split() or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert {r.doc_id for r in steps[3].collect()} == {rows[i][0] for i in set(root)}


def test_stages_on_empty_null_and_odd_rows(spark):
    """Null ids, texts and sources, empty texts, repeated rows and columns named like inner ones pass every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, _body string"
    rows = [(1, "one two three\nfour", "en", "a", 18, 5, "x"), (2, None, None, None, None, None, None), (None, "no id here", "en", None, 10, 1, ""),
            (4, "", "de", "a", 0, 2, "y"), (5, "w " * 30_000, "fr", "b", 60_000, 3, "z"), (5, "w " * 30_000, "fr", "b", 60_000, 3, "z")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.dtypes == docs.dtypes
            out.collect()
        assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()
