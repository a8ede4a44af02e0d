"""SimHash fingerprints and components against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash

from voxrill.llm import simhash


def plain_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [words] if len(words) <= size else [words[i:i + size] for i in range(len(words) - size + 1)]
    h = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, f, ids.get(find(i))) for i, (d, f) in enumerate(rows)]


def near_texts(n, seed=5):
    rng = random.Random(seed)
    base = ["w%d" % rng.randrange(3000) for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(100)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 4])
def test_components(spark, chunk):
    texts = [None, "", " \n", "One two", "one TWO", "a b c", "É one two three"] + near_texts(60) + [" ".join("q%d" % (i * k) for i in range(50)) for k in range(30)]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_components([(d, plain_fingerprint(t, 3)) for d, t in rows], 2)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.clusters(df, 3, 2, chunk=chunk).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_buckets_stay_whole_when_a_join_turns(spark):
    """Adaptive execution may broadcast the bucket sizes after all; the rows of a bucket still meet in one task."""
    texts = near_texts(150, seed=11) + [" ".join("q%d" % (i * k) for i in range(50)) for k in range(60)]
    random.Random(1).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    want = plain_components([(d, plain_fingerprint(t, 3)) for d, t in enumerate(texts)], 2)
    # Several tasks write the bucket rows, as they do at size, and the planner learns only at run time that few buckets are shared.
    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.clusters(df, 3, 2).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got) == sorted(want)


def test_bit_slices():
    rng = np.random.default_rng(1)
    block = rng.integers(0, 2**64, 150, dtype=np.uint64)
    queries = np.concatenate([block[:20] ^ np.uint64(5), block[:20] ^ np.uint64(1 << 63), block[20:40] ^ np.uint64(7), rng.integers(0, 2**64, 9, dtype=np.uint64)])
    near = simhash.close(queries, simhash.planes(block), len(block), 2)
    want = np.array([[bin(int(q ^ b)).count("1") <= 2 for b in block] for q in queries])
    assert (near == want).all()


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 14, 22, 63, 64])
@pytest.mark.parametrize("count", [1, 63, 64, 65, 300])
def test_counters_of_all_sizes(radius, count):
    """Pairs at distances around the radius, and a chunk compared with itself: each pair once, no row with itself."""
    rng = np.random.default_rng(radius)
    block = rng.integers(0, 2**64, count, dtype=np.uint64)
    for i in range(1, count):  # relatives of an earlier row
        block[i] = block[rng.integers(0, i)]
        for b in rng.permutation(64)[: rng.integers(0, min(64, radius + 3) + 1)]:
            block[i] ^= np.uint64(1) << np.uint64(b)
    want = np.bitwise_count(block[:, None] ^ block[None, :]) <= radius
    sliced = simhash.planes(block)
    assert (simhash.close(block, sliced, count, radius) == want).all()
    earlier = np.arange(count)[None, :] < np.arange(count)[:, None]
    assert (simhash.close(block, sliced, count, radius, np.arange(count)) == (want & earlier)).all()


def test_far_words_leave_early():
    """Words without a near fingerprint leave before the last bits, although the queries stand in the block."""
    rng = np.random.default_rng(3)
    block = rng.integers(0, 2**64, 4000, dtype=np.uint64)  # the last word has padding
    work = []
    near = simhash.close(block[-64:], simhash.planes(block), len(block), 2, np.arange(3936, 4000), work)
    assert not near.any()
    assert work[0] == 62 * 64 + 31  # words with lanes of earlier rows: 62 for each query, one more for the last 31
    assert len(work) < 8 and sum(work) < 3 * work[0]


def test_exact_route_loses_no_pair(spark):
    """Buckets of rare shingles against all exact similarities, with texts of few words, copies and none."""
    texts = pairs_of_all_similarities(80, 12) + ["", None, "a b c d e f g h i", "a b c d e f g h i j", "a b c d e f g h", "one", "one", "a b c d e f g h i"]
    passage = " ".join("p%d" % k for k in range(60))
    texts += ["%s tail%d" % (passage, i) for i in range(30)]
    want, seen = plain_similar([t or "" for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for chunk in (simhash.CHUNK, 8):
        assert {r.doc_id for r in simhash.keep_one(df, chunk=chunk, exact=True).collect()} == want
    assert simhash.keep_one(df.limit(0), exact=True).count() == 0


def test_bands_lose_no_pair():
    rng = random.Random(2)
    keys = simhash._bands(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(3)):
            b ^= 1 << rng.randrange(64)
        assert any(all((a >> at) & ((1 << w) - 1) == (b >> at) & ((1 << w) - 1) for at, w in fields) for fields in keys)


def test_keep_one(spark):
    rows = [(3, "same text here", "x"), (1, "same text here", "y"), (1, "same text here", "y"), (None, None, "z"), (None, "", "w"), (9, "other words stand in this one", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.fp) for r in got.collect()]
    assert sorted(k for k in kept if k[0] is not None) == [(1, "y"), (9, "v")]
    assert len(kept) == 3
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_similar_texts(spark):
    """Pairs with a similarity of 0.8 or more of five-word shingles; others stay apart."""
    rng = random.Random(8)
    rows, near = [], 0
    for i in range(150):
        words = ["w%d" % rng.randrange(5000) for _ in range(rng.randrange(120, 400))]
        rows.append((2 * i, " ".join(words)))
        edited = list(words)
        for _ in range(max(1, len(words) // 150)):
            edited[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
        runs = [{tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (words, edited)]
        near += len(runs[0] & runs[1]) / len(runs[0] | runs[1]) >= 0.8
        rows.append((2 * i + 1, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {2 * i for i in range(150)} <= kept
    assert len(kept) - 150 <= 150 - 0.97 * near


def test_chunks_give_the_same_components(spark):
    """A bucket dealt into chunks, in both forms of the operator."""
    texts = near_texts(80, seed=9) + ["lone text number %d of some words here" % i for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for similar, radius in ((True, 14), (False, 2)):
        a, b = (sorted(r.doc_id for r in simhash.keep_one(df, 5, radius, similar, chunk=c).collect()) for c in (simhash.CHUNK, 8))
        assert a == b


def runs_of(text):
    words = text.split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def plain_similar(texts):
    """The smallest member of each component of pairs with a Jaccard similarity of 0.8 or more; and all pairs' similarities."""
    sets, root, seen = [runs_of(t) for t in texts], list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            seen.append(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
            if seen[-1] >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {i for i, r in enumerate(root) if r == i}, seen


def pairs_of_all_similarities(n, seed):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = ["w%d" % rng.randrange(5000) for _ in range(rng.randrange(60, 300))]
        edited, at = list(words), rng.randrange(len(words) // 2)
        cut = rng.randrange(1, max(3, len(words) // 5))
        edited[at:at + cut] = ["e%d" % rng.randrange(10**6) for _ in range(cut)]
        texts += [" ".join(words), " ".join(edited)]
    return texts


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 8])
def test_only_similar_texts_are_linked(spark, chunk):
    """Pairs between 0.5 and 1, and texts that share one long passage, against all exact similarities."""
    rng = random.Random(4)
    passage = ["p%d" % k for k in range(50)]
    texts = pairs_of_all_similarities(150, 3)
    for i in range(60):
        own = ["o%d_%d" % (i, k) for k in range(rng.randrange(12, 50))]
        texts.append(" ".join(passage + own if i % 2 else own + passage))
    want, seen = plain_similar(texts)
    assert sum(0.5 <= s < 0.8 for s in seen) > 50 < sum(s >= 0.8 for s in seen)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one(df, chunk=chunk).collect()}
    assert want <= kept  # nothing goes that no similarity takes away
    assert len(kept) - len(want) <= 0.1 * (len(texts) - len(want))


def test_copies_with_a_repeated_line(spark):
    """A copy that gains one line ten times, or an edit that leaves a similarity just above 0.8, is still one."""
    rng = random.Random(6)
    texts = []
    for i in range(60):
        words = ["w%d" % rng.randrange(5000) for _ in range(200)]
        if i % 2:
            other = words + ["line%d_%d" % (i, k) for k in range(10)] * 10
        else:
            other = words[:180] + ["e%d_%d" % (i, k) for k in range(20)]
        texts += [" ".join(words), " ".join(other)]
    want, _ = plain_similar(texts)
    assert len(want) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want
