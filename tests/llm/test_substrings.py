"""Substring dedup against a dictionary of all windows."""

import random

import pytest

from voxrill.llm import substrings


def brute(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        for p in range(len(ws) - window + 1):
            k = tuple(ws[p:p + window])
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = []
    for d, ws in split:
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p:p + window])] != (d, p):
                gone.update(range(p, p + window))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(50)}" for _ in range(rng.randrange(5, 60))] for k in range(6)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a:] if rng.random() < 0.5 else p
            else:
                words += [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        if rng.random() < 0.1:
            words += ["same"] * rng.randrange(50)
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(n + k, rows[k][1]) for k in range(5)] + [(n + 9, None), (n + 10, ""), (n + 11, "é " * 3000)]
    return rows


@pytest.mark.parametrize("window,parts", [(20, 4), (20, 1), (7, 3), (8, 5)])
def test_against_dictionary(spark, window, parts):
    rows = corpus(window + parts)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    kept = {r.doc_id: r.text for r in substrings.drop_repeats(df, window).collect()}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.repeat_digests(df, window).collect()}
    for d, n, gone, text in brute(rows, window):
        assert got[d] == (n, gone), d
        if gone:
            assert kept[d] == text


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, long, 1), (5, long, 2), (5, long, 3), (6, None, 4)], "doc_id long, text string, runs int")
    got = substrings.drop_repeats(df)
    assert got.columns == df.columns
    # Null ids come last; rows equal in id and text are judged alike, neither before the other.
    assert {(r.runs, r.text) for r in got.collect()} == {(1, ""), (2, long), (3, long), (4, None)}
    assert substrings.repeat_digests(df.limit(0)).count() == 0
