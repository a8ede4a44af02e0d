"""Merkle manifest against a plain recursive version, with small superblocks so that every round takes part."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from voxrill.llm import merkle
from voxrill.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    told = []
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]):
        told.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(told)


def tree(nodes):
    """(root, for each node its list of (place, other nodes) level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 16
            run = nodes[first:first + 16]
            paths[i].append((p - first, run[:p - first] + run[p - first + 1:]))
            at[i] = p // 16
        nodes = [h(nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        mine = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)), i, r) for i, r in enumerate(by_source[s]))
        subs[s] = (mine, *tree([k[2] for k, _, _ in mine]))
    root, above = tree([subs[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        mine, subroot, paths = subs[s]
        for (key, _, r), path in zip(mine, paths):
            leaf = key[2]
            node = leaf
            if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] is not None and r["text"] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                node = plain_leaf({**r, "text": low})
            for place, others in path + up:
                node = h(others[:place] + [node] + others[place:])
            out.append((r["doc_id"], leaf, subroot, root, h([x for _, o in path + up for x in o]), node, node == root))
    return out


def run(docs, depth=merkle.DEPTH):
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(docs, tampered={"text": merkle.lower_ascii(docs["text"])}, when=hit, depth=depth)


KEY = lambda r: (r[0] is not None, r[0] or 0, r[1:])


def same(got, want):
    return sorted(map(tuple, got), key=KEY) == sorted(want, key=KEY)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_against_plain(spark, depth):
    """One source holds most rows, another one row, and there are more sources than a run has nodes."""
    rng = random.Random(depth)
    ids = rng.sample(range(10**7), 700)
    rows = [dict(doc_id=i, text="".join(rng.choice("aBcÉ ß👍\n") for _ in range(rng.randrange(12))), lang=rng.choice(["en", None]),
                 source=rng.choice(["hot"] * 6 + [f"s{k}" for k in range(20)] + ["é", "", None]), n_chars=rng.choice([None, i])) for i in ids]
    rows.append(dict(doc_id=-5, text=None, lang=None, source="alone", n_chars=None))
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], KIND)
    assert same(run(docs.repartition(5), depth).collect(), plain(rows))


def test_three_rounds_and_exact_powers(spark):
    for n in (1, 16, 17, 257):
        rows = [dict(doc_id=i, text=f"T{i}", lang="en", source="s", n_chars=i) for i in range(n)]
        docs = spark.createDataFrame([(i, f"T{i}", "en", "s", i) for i in range(n)], KIND)
        assert same(run(docs, 1).collect(), plain(rows)), n


def test_edges(spark):
    """Repeated rows, null ids, a very long text, clashing column names and an empty table."""
    rows = [(1, "A" * 200_000, "en", "s", 1, "x"), (2, "b", "en", "s", 1, "x"), (2, "b", "en", "s", 1, "x"), (2, "a", None, "s", 1, None),
            (None, "n", None, None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, KIND + ", leaf string").withColumn("_group", F.lit(1)).withColumn("_at", F.lit("z"))
    want = plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert same(run(docs).collect(), want)
    none = run(docs.limit(0))
    assert none.count() == 0 and none.dtypes == run(docs).dtypes
    assert merkle.manifest(docs).where("verified").count() == len(rows)


def test_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert same(QUERIES["op12_merkle"](spark, SF).collect(), plain(rows))
