"""Near duplicates by SimHash fingerprints of 64 bits.

Equal fingerprints are one row from the start. Two fingerprints within radius r agree on one of r + 1
bands of bits, and on the rest of the bits, which differ in at most r places as well, on one of r + 1
sub-bands; so each fingerprint is sent once for each pair of band and sub-band, to a bucket of close
relatives. Inside a bucket the bits stand in vertical planes, one machine word holding the same bit of
64 fingerprints: a query adds its differing bits to all 64 distances at once, in vertical binary counters
fed by carry-save adders, and leaves a word as soon as all its distances exceed the radius. A bucket
sends on only the links that join it up, at most as many as it has rows; components follow from those.

Buckets above a bounded size are dealt into chunks, and pairs of chunks are compared in tasks of their
own, so no bucket has to fit a task and no candidate is lost.

Near copies by similarity (``keep_one``) take buckets from the shingles instead, and there the bit-sliced
comparison only finds candidates: two texts are linked if their sets of shingle hashes have a Jaccard
similarity of ``SIMILAR`` or more, counted exactly. Only texts with a candidate send their sets, once for
each group of candidates they are in, not for each bucket.

Null and empty texts, and texts without words, have fingerprint zero and link like any other. Repeated
rows have equal fingerprints and one component. Rows with a null id take part; a component's id is its
smallest id that is not null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrill.llm import common
from voxrill.llm.components import components
from voxrill.llm.registry import query
from voxrill.session import cut_lineage

BITS = 64
#: Fingerprints that one task compares with each other or with as many others.
CHUNK = 4096
#: Shingle hashes that one task compares with each other or with as many others.
CHUNK_HASHES = 1 << 19
#: The least Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Differing bits that rule a candidate out; about 10 are usual at that similarity.
SIMILAR_RADIUS = 22
#: Queries that are compared with a block at a time.
QUERIES_AT_ONCE = 256


def shingle_hashes(text: bytes, size: int, lower: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words; of all words if they are fewer."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if lower:
        joined = joined.lower()
    h = xxhash.xxh64_intdigest
    n = len(words)
    if n <= size:
        return np.array([h(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: n - size] + 1).tolist()]
    ends = [*gaps[size - 1:].tolist(), len(joined)]
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for long texts
        part = h[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int, lower: bool = True) -> int:
    """The bits that are set in over half of the shingle hashes; zero without words."""
    return _majority(shingle_hashes(text, size, lower))


def fingerprints(wrapped: DataFrame, size: int = 5, lower: bool = True) -> DataFrame:
    """(_row, _id, fp): every wrapped row with its fingerprint as a signed long."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(raw.as_py(), size, lower) for raw in batch.column(2)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["_row", "_id", "fp"])

    id_type = wrapped.schema["_id"].dataType.simpleString()
    return wrapped.select("_row", "_id", "_body").mapInArrow(common.by_batch(per_batch), f"_row long, _id {id_type}, fp long")


def _field(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _split(total: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of nearly equal parts."""
    edges = [total * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bands(radius: int) -> list[list[tuple[int, int]]]:
    """The bit fields of each bucket key: a band, and a sub-band of the bits outside it."""
    keys = []
    for at, width in _split(BITS, radius + 1):
        rest = [b for b in range(BITS) if not at <= b < at + width]
        for sub, sub_width in _split(len(rest), radius + 1):
            bits = rest[sub:sub + sub_width]
            fields, begin = [], bits[0]
            for a, b in zip(bits, [*bits[1:], None]):
                if b != a + 1:
                    fields.append((begin, a - begin + 1))
                    begin = b
            keys.append([(at, width), *fields])
    return keys


def planes(fps: np.ndarray) -> np.ndarray:
    """The fingerprints as BITS planes of packed 64-bit words; the last word is filled with zeros."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _ones_from(lanes: np.ndarray) -> np.ndarray:
    """Words whose bits from the given lane on are set; all for lane 0 or less, none from 64 on."""
    return np.where(lanes >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) << np.clip(lanes, 0, 63).astype(np.uint64))


def close(queries: np.ndarray, block: np.ndarray, count: int, radius: int, before: np.ndarray | None = None, work: list[int] | None = None) -> np.ndarray:
    """For each query, which of the ``count`` fingerprints of a bit-sliced block lie within the radius.

    With ``before``, a query is compared only with the lanes below its number there: its own place, where a
    chunk is compared with itself.

    A distance is a binary counter that stands vertically in a few planes. It starts so that it overflows
    when it passes the radius, and that overflow sticks. Differing bits are added eight at a time, by
    carry-save adders that take two words of a weight and pass one carry on. A word of 64 lanes leaves the
    working set as soon as all its lanes have overflowed; lanes that are padding or not asked for count as
    overflowed from the start. ``work`` gets the number of words compared at each eight bits.
    """
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    words = block.shape[1]
    last = np.full(len(queries), count) if before is None else np.minimum(before, count)
    over = _ones_from(last[:, None] - 64 * np.arange(words)[None, :])
    query, word = np.nonzero(over != ones)
    over = over[query, word]
    levels = int(radius).bit_length()  # 2 ** levels > radius
    start = 2**levels - (radius + 1)
    counter = [np.full(len(over), ones if start >> k & 1 else np.uint64(0)) for k in range(levels)]
    set_bits = [np.where(queries >> np.uint64(b) & np.uint64(1), ones, np.uint64(0)) for b in range(BITS)]

    def add(level: int, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """Adds one or two words of a weight; the carry has the next weight. Beyond the counter it is overflow."""
        if level >= levels:
            over[...] |= x if y is None else x | y
            return np.zeros_like(x)
        held = counter[level]
        if y is None:
            counter[level] = held ^ x
            return held & x
        half = held ^ x
        counter[level] = half ^ y
        return (held & x) | (half & y)

    for at in range(0, BITS, 8):
        if not len(over):
            break
        if work is not None:
            work.append(len(over))
        d = [np.take(block[b], word) ^ np.take(set_bits[b], query) for b in range(at, at + 8)]
        twos = [add(0, d[k], d[k + 1]) for k in range(0, 8, 2)]
        fours = [add(1, twos[k], twos[k + 1]) for k in (0, 2)]
        carry = add(2, *fours)
        for level in range(3, levels + 1):
            carry = add(level, carry)
        alive = over != ones
        if 4 * np.count_nonzero(alive) <= 3 * len(alive):  # copying out pays when a quarter has left
            query, word, over, counter = query[alive], word[alive], over[alive], [c[alive] for c in counter]
    near = np.zeros((len(queries), words, 64), bool)
    near[query, word] = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return near.reshape(len(queries), -1)[:, :count]


def _join_up(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that give the same components as all pairs within the radius between the two sides."""
    both = np.unique(np.concatenate([left, right]))
    label = np.arange(len(both))  # the component so far
    sliced = planes(right)
    place = np.searchsorted(both, right)
    for at in range(0, len(left), QUERIES_AT_ONCE):
        part = left[at:at + QUERIES_AT_ONCE]
        near = close(part, sliced, len(right), radius, np.arange(at, at + len(part)) if left is right else None)
        for i, row in zip(np.searchsorted(both, part).tolist(), near):
            others = place[row]
            others = others[label[others] != label[i]]
            while len(others):
                yield int(both[i]), int(both[others[0]])
                label[label == label[others[0]]] = label[i]
                others = others[label[others] != label[i]]


def _bucket_links(nodes: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links between the nodes of one bucket; side 1 marks the rows of a second chunk, if there is one."""
    kinds, first, which = np.unique(fps, return_index=True, return_inverse=True)
    speaks = nodes[first]  # the node that stands for a fingerprint
    for a, b in zip(nodes.tolist(), speaks[which].tolist()):
        if a != b:
            yield a, b
    if len(kinds) == 1:
        return
    of = dict(zip(kinds.tolist(), speaks.tolist()))
    two = side.any() and not side.all()
    left, right = (np.unique(fps[side == 0]), np.unique(fps[side == 1])) if two else (kinds, kinds)
    for x, y in _join_up(left, right, radius):
        yield of[x], of[y]


def _bucket_groups(nodes: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(group, node) of the nodes of one bucket that chains of links hold together.

    A group's number is a hash of its nodes, the same in whatever bucket they meet; it is odd where the
    group lies across two chunks.
    """
    root = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in _bucket_links(nodes, fps, side, radius):
        root[find(a)] = find(b)
    groups: dict[int, list[int]] = {}
    for a in sorted(root):
        groups.setdefault(find(a), []).append(a)
    across = int(side.any() and not side.all())
    for held in groups.values():
        number = xxhash.xxh64_intdigest(np.array(held, np.int64).tobytes(), 11) & ~1 | across
        yield from ((number - (number >> 63 << 64), a) for a in held)


def _exact_links(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], radius: int) -> Iterator[tuple[int, int]]:
    """Links that give the same components as all pairs that lie within the radius and are similar."""
    size = np.array([len(s) for s in sets])
    edge = np.concatenate([[0], np.cumsum(size)])
    kinds, which = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), np.int64)
    label = np.arange(len(nodes))  # the component so far
    sliced = planes(fps)
    num, den = SIMILAR
    for at in range(0, len(nodes), QUERIES_AT_ONCE):
        part = fps[at:at + QUERIES_AT_ONCE]
        for i, row in enumerate(close(part, sliced, len(nodes), radius, np.arange(at, at + len(part))), at):
            others = np.flatnonzero(row)
            small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            others = others[(label[others] != label[i]) & (small * den >= large * num)]
            mark[which[edge[i]:edge[i + 1]]] = 1
            take = 1  # candidates compared at a time: few while they tend to be similar, more when they are not
            while len(others):
                now, others = others[:take], others[take:]
                for j in now.tolist():
                    common_hashes = int(mark[which[edge[j]:edge[j + 1]]].sum())
                    if label[j] != label[i] and common_hashes * (den + num) >= num * int(size[i] + size[j]):
                        yield int(nodes[i]), int(nodes[j])
                        label[label == label[j]] = label[i]
                others = others[label[others] != label[i]]
                take = min(2 * take, 64)
            mark[which[edge[i]:edge[i + 1]]] = 0


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _columns(found: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())]


def _in_chunks(radius: int, of=_bucket_links):
    def link(table: pa.Table) -> pa.Table:
        """One pair of chunks of a large bucket, or one chunk with itself."""
        node, fp, side = (np.asarray(table.column(c)) for c in ("node", "fp", "side"))
        return pa.Table.from_arrays(_columns(list(of(node, fp.view(np.uint64), side, radius))), schema=_LINKS)

    return link


def _in_order(radius: int, of=_bucket_links):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (at, node, fp), numbered from 1 in each bucket: whole buckets, each of at most a chunk's rows."""
        held = [np.zeros(0, np.int64) for _ in range(3)]

        def found(at, nodes, fps) -> pa.RecordBatch:
            edges = np.flatnonzero(at == 1).tolist()
            out: list[tuple[int, int]] = []
            for lo, hi in zip(edges, [*edges[1:], len(at)]):
                if hi - lo > 1:
                    out.extend(of(nodes[lo:hi], fps[lo:hi].view(np.uint64), np.zeros(hi - lo, np.int32), radius))
            return pa.RecordBatch.from_arrays(_columns(out), schema=_LINKS)

        for batch in batches:
            held = [np.concatenate([h, np.asarray(batch.column(i))]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            last = int(np.flatnonzero(held[0] == 1)[-1])  # the last bucket may go on in the next batch
            if last:
                yield found(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield found(*held)

    return link


def band_buckets(fp: Column, radius: int) -> Column:
    """Bucket keys that any two fingerprints within the radius share at least one of."""
    return F.array(*[F.xxhash64(F.lit(k), *[_field(fp, at, width) for at, width in fields]) for k, fields in enumerate(_bands(radius))])


def links(kinds: DataFrame, radius: int, chunk: int = CHUNK, of=_bucket_links) -> DataFrame:
    """(a, b): links between the nodes of ``kinds`` (node, fp, buckets) that share a bucket and lie within the radius.

    They give the same components as all such pairs. With a column n of ``kinds``, the number of a node's
    hashes, chunks have a bound on those as well. ``of`` says what a bucket gives.
    """
    weighs = [c for c in ("n",) if c in kinds.columns]
    sent = cut_lineage(kinds.select(F.explode("buckets").alias("bucket"), "node", "fp", *weighs))
    # Dealt anew, so that the joins below can split a hot bucket.
    load = F.sum(F.greatest(F.lit(1 / chunk), F.col("n") / CHUNK_HASHES)) if weighs else F.count("*") / F.lit(chunk)
    sizes = sent.groupBy("bucket").agg(F.count("*").alias("count"), load.alias("load")).where("count > 1").hint("rebalance")
    # Buckets of one row, nearly all, end here.
    shared = sent.join(sizes.where("load <= 1").select("bucket"), "bucket", "left_semi")
    # A window keeps a bucket's rows together however its join is made. A repartition by the join's own key does not:
    # the planner leaves it out, and adaptive execution may broadcast the sizes later and read the rows as they lie.
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("node")).cast("long")
    found = shared.select(at.alias("at"), "node", "fp").mapInArrow(_in_order(radius, of), "a long, b long")
    # A large bucket: every pair of its chunks is a group of its own.
    large = sizes.where("load > 1").withColumn("chunks", F.ceil(2 * F.col("load")).cast("long"))
    # Every bucket deals in its own way, so that nodes of several common buckets soon meet inside a chunk.
    dealt = sent.join(large, "bucket").withColumn("mine", F.pmod(F.xxhash64("node", "bucket", F.lit(1)), "chunks"))
    pairs = dealt.select(
        "bucket", "node", "fp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    ).select(
        "bucket", "node", "fp", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    return found.unionByName(pairs.groupBy("bucket", "low", "high").applyInArrow(_in_chunks(radius, of), "a long, b long"))


def _in_groups(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, node, fp, hashes) sorted by group: the exact links of each group."""

        def found(rows: pa.Table) -> pa.RecordBatch:
            keys, nodes, fps = (np.asarray(rows.column(c)) for c in ("group", "node", "fp"))
            sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows.column("hashes")]
            edges = np.flatnonzero(np.diff(keys)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                out.extend(_exact_links(nodes[lo:hi], fps[lo:hi].view(np.uint64), sets[lo:hi], radius))
            return pa.RecordBatch.from_arrays(_columns(out), schema=_LINKS)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = np.asarray(held.column("group"))
            last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
            if last:
                yield found(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield found(held)

    return link


def _exact(groups: DataFrame, kinds: DataFrame, wrapped: DataFrame, size: int, radius: int) -> DataFrame:
    """(a, b): the similar texts of each group (group, node); ``kinds``: (node, fp, text_row)."""

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(raw.as_py(), size)).tobytes() for raw in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["node", "fp", "hashes"])

    wanted = cut_lineage(kinds.join(groups.select("node").distinct(), "node", "left_semi").select("node", "fp", F.col("text_row").alias("_row")))
    sets = wrapped.select("_row", "_body").join(wanted, "_row").select("node", "fp", "_body").mapInArrow(
        common.by_batch(hashes), "node long, fp long, hashes binary"
    ).groupBy("node").agg(F.first("fp").alias("fp"), F.first("hashes").alias("hashes"))  # a row may be repeated
    return cut_lineage(
        groups.join(sets, "node").select("group", "node", "fp", "hashes")
        .repartition(common.partitions(groups.sparkSession), "group").sortWithinPartitions("group")
        .mapInArrow(_in_groups(radius), "a long, b long")
    )


def similar_links(kinds: DataFrame, wrapped: DataFrame, size: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between the texts of ``kinds`` (node, fp, buckets, n, text_row) that share a bucket, lie
    within the radius and are similar. They give the same components as all such pairs.

    Groups across chunks come last: those that the others have joined up already need no comparison.
    """
    found = links(kinds.select("node", "fp", "buckets", "n"), radius, chunk, _bucket_groups)
    groups = cut_lineage(found.select(F.col("a").alias("group"), F.col("b").alias("node")).distinct())
    odd = F.col("group").bitwiseAND(F.lit(1)) == 1
    inside = _exact(groups.where(~odd), kinds, wrapped, size, radius)
    across = groups.where(odd)
    if across.isEmpty():
        return inside
    known = components(inside)
    apart = across.join(known, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root")).groupBy("group").agg(
        F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low <> high").select("group").hint("rebalance")
    left = cut_lineage(across.join(apart, "group", "left_semi"))
    return inside.unionByName(_exact(left, kinds, wrapped, size, radius))


def _named(marked: DataFrame, node: str, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """``marked`` with root (a node that names the component) and component_id; ``kinds``: (node, least), ``found``: links."""
    linked = components(found).withColumnRenamed("node", "_linked")
    member = cut_lineage(kinds.join(linked, F.col("node") == F.col("_linked"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = member.groupBy("root").agg(F.min("least").alias("component_id")).hint("rebalance")
    named = member.join(least, "root").select(F.col("node").alias(node), "root", "component_id")
    return marked.join(named, node)


def members(wrapped: DataFrame, size: int, radius: int, lower: bool, chunk: int) -> DataFrame:
    """(_row, _id, fp, root, component_id) of wrapped rows: all fingerprints within the radius are linked."""
    marked = cut_lineage(fingerprints(wrapped, size, lower))
    kinds = marked.groupBy("fp").agg(F.min("_id").alias("least"))
    kinds = kinds.select(F.col("fp").alias("node"), "fp", band_buckets(F.col("fp"), radius).alias("buckets"), "least")
    return _named(marked, "fp", kinds, links(kinds.select("node", "fp", "buckets"), radius, chunk))


#: Bins of a text's smallest shingle hashes, and the bands of them that bring similar texts together.
BINS, BANDS, BAND_ROWS = 128, 20, 5
_BORROW = (common.mix64(np.arange(1, BINS * 64 + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(64, BINS)
_WEIGH = common.mix64(np.arange(1, BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def similar_buckets(h: np.ndarray) -> np.ndarray:
    """Keys of which texts with a large share of common shingles have at least one in common.

    The smallest hash of each of BINS bins, empty bins borrowing from full ones; each key takes in BAND_ROWS
    bins. Texts with four fifths of their shingles in common share none of the BANDS keys once in 3 000 pairs.
    """
    least = np.full(BINS, 2**64 - 1, np.uint64)
    order = np.argsort(h)[::-1]
    least[(h[order] & np.uint64(BINS - 1)).astype(np.int64)] = h[order]
    full = least != 2**64 - 1
    out, empty = least.copy(), np.flatnonzero(~full)
    for row in _BORROW:
        if not len(empty):
            break
        found = full[row[empty]]
        out[empty[found]] = least[row[empty[found]]]
        empty = empty[~found]
    out[empty] = least[full][0] if full.any() else 0
    keys = (out[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS) * _WEIGH).sum(1, dtype=np.uint64)
    return common.mix64(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def rare_buckets(kinds: DataFrame, wrapped: DataFrame, size: int) -> DataFrame:
    """``kinds`` (node, text_row, ...) with buckets that any two similar texts are sure to share.

    A text's buckets are its rarest shingles, so many that a similar text, which lacks at most a fifth of
    them, has one of those as well among its own rarest. Shingles of one text make no bucket.
    """

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(raw.as_py(), size)).view(np.int64) for raw in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = wrapped.select("_row", "_body").join(kinds.select("node", F.col("text_row").alias("_row")), "_row").select("node", "_body")
    sets = texts.mapInArrow(common.by_batch(shingles), "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes"))
    each = cut_lineage(sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("h")))
    seen = each.groupBy("h").agg(F.count("*").alias("seen")).hint("rebalance")
    num, den = SIMILAR
    rank = F.row_number().over(Window.partitionBy("node").orderBy("seen", "h"))
    rare = each.join(seen, "h").withColumn("at", rank).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).where("seen > 1")
    return kinds.drop("buckets").join(rare.groupBy("node").agg(F.collect_list("h").alias("buckets")), "node", "left")


def similar_members(wrapped: DataFrame, size: int, radius: int, chunk: int, exact: bool = False) -> DataFrame:
    """(_row, _id, text_key, root, component_id): similar texts that share a bucket and lie within the radius are linked.

    With ``exact`` every pair of similar texts is found, whatever the radius: buckets come from rare shingles.

    A radius that goes with a similarity of shingles well below 1 is too wide for bands of the fingerprint
    itself; buckets come from the shingles then, fingerprints give candidates, and the shingles decide.
    Fingerprints are those of the distinct shingles.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps, buckets, n = [], [], [], []
        for raw in batch.column(2):
            text = raw.as_py()
            h = shingle_hashes(text, size)
            keys.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7))
            h = np.unique(h)  # a repeated passage does not count twice
            fps.append(_majority(h))
            buckets.append(similar_buckets(h))
            n.append(len(h))
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(buckets, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["_row", "_id", "text_key", "fp", "buckets", "n"])

    id_type = wrapped.schema["_id"].dataType.simpleString()
    marked = cut_lineage(wrapped.select("_row", "_id", "_body").mapInArrow(
        common.by_batch(per_batch), f"_row long, _id {id_type}, text_key long, fp long, buckets array<long>, n long"
    ))
    kinds = marked.groupBy(F.col("text_key").alias("node")).agg(
        F.min("_id").alias("least"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"), F.first("n").alias("n"), F.min("_row").alias("text_row")
    )
    if exact:
        kinds, radius = cut_lineage(rare_buckets(kinds, wrapped, size)), BITS
    return _named(marked.select("_row", "_id", "text_key"), "text_key", kinds, similar_links(kinds, wrapped, size, radius, chunk))


def clusters(docs: DataFrame, size: int = 5, radius: int = 2, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: its id, fp (signed long) and component_id."""
    found = members(common.wrap(docs, id_col, text_col), size, radius, lower, chunk)
    return found.select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(
    docs: DataFrame, size: int = 5, radius: int = SIMILAR_RADIUS, similar: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
    exact: bool = False,
) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id, null ids last, then of the least row hash.

    As it stands, for shingles of five words with a similarity of 0.8 or more: the sets of shingles decide
    among texts within the radius. ``exact`` finds every such pair, at the price of shuffling all shingle hashes.
    ``similar=False`` links all fingerprints within the radius, which must be small then.
    """
    wrapped = common.wrap(docs, id_col, text_col)
    found = similar_members(wrapped, size, radius, chunk, exact) if similar else members(wrapped, size, radius, True, chunk)
    keeper = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).getField("_row").alias("_row"))
    held = wrapped.join(keeper.select("_row").distinct(), "_row", "left_semi")
    # A row that repeats the keeper in id and text shares its hash; one of them stays.
    alone = held.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).where("_n = 1")
    return alone.select(*common.given(docs.columns))


@query("op6_simhash")
def op6_simhash(spark, d):
    """Fingerprints of three-word shingles; components at two or fewer differing bits."""
    found = clusters(common.table(spark, d, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
