"""Line dedup against a plain count over all lines."""

import collections

import pytest

from voxrill.llm import bloom, linededup
from voxrill.llm.linededup import line_key

TEXTS = [None, "", "\n\n", "Footer\nown a", " footer \t\nown b", "FOOTER\nown b\nown b", "own b", "é\nfooter", "é\x0b", "x" * 50_000 + "\nfooter", "own c", "own c"]


def brute(rows, min_docs, min_chars, keep):
    docs = collections.Counter()
    first = {}
    for key, text in rows:
        for k in {line_key(x) for x in (text or "").encode().split(b"\n")}:
            docs[k] += 1
            first[k] = min(first.get(k, key), key)
    out = []
    for key, text in rows:
        kept, shown = [], set()
        for line in (text or "").encode().split(b"\n"):
            k = line_key(line)
            if docs[k] >= min_docs and len(k.decode()) >= min_chars:
                if keep == "first" and first[k] == key and k not in shown:
                    shown.add(k)
                else:
                    continue
            kept.append(line)
        out.append((key, b"\n".join(kept).decode()))
    return sorted(out)


@pytest.mark.parametrize("min_docs,min_chars,keep", [(2, 1, "first"), (2, 1, "none"), (3, 1, "none"), (2, 2, "none"), (2, 0, "none")])
def test_against_count(spark, min_docs, min_chars, keep):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = linededup.drop_lines(df, min_docs, min_chars, keep).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == brute(rows, min_docs, min_chars, keep)


def test_edges(spark):
    df = spark.createDataFrame([(None, "same\nline", 1), (None, "same\nline", 2), (3, None, 3)], "doc_id long, text string, _row int")
    got = linededup.drop_lines(df, 2, 1, "none")
    assert got.columns == df.columns
    assert sorted((r._row, r.text) for r in got.collect()) == [(1, ""), (2, ""), (3, None)]
    assert linededup.drop_lines(df.limit(0)).count() == 0
    assert linededup.line_digests(df.limit(0), 2, 1, "none").count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With far too few bits every line is a suspect; the result is the same."""
    monkeypatch.setattr(bloom, "filter_bits", lambda n: bloom.SLICE_BITS)
    rows = [(i, "\n".join(f"line {i * 7 + k}" for k in range(500)) + f"\nshared {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_lines(df, 10, 1, "none").collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute(rows, 10, 1, "none")
