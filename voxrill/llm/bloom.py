"""A pair of Bloom filters, for hashes seen once and for hashes seen at least twice.

Each input task sends its distinct hashes, packed, to the slice of the bit range they belong to.
The task of a slice folds them into two bitmaps: a hash whose bits are all set in the first has been
seen before and goes into the second. The size in bits is bounded by a parameter, so the broadcast
is bounded too. Beyond that bound more hashes look repeated, never fewer: readers confirm every
suspect exactly, so results do not depend on the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrill.llm.common import partitions

#: Bits for each expected hash, and the most bits of one filter (2**29 bits are 64 MB).
BITS_PER_HASH = 16
PROBES = 4
MAX_BITS = 2**29
#: Bits of one slice, the unit that is folded in one piece (64 KB).
SLICE_BITS = 2**19
#: Hashes in one packed row.
PACK = 1 << 15

PACKED = "slice int, packed binary, again binary"
_TYPES = pa.schema([("slice", pa.int32()), ("packed", pa.binary()), ("again", pa.binary())])


def filter_bits(expected: int, most: int = MAX_BITS) -> int:
    """A power of two that gives each expected hash its bits, within the bound."""
    want = max(SLICE_BITS, expected * BITS_PER_HASH)
    return min(most, 1 << (int(want) - 1).bit_length())


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The PROBES bit positions inside the slice of each hash."""
    mask = np.uint64(SLICE_BITS - 1)
    first, step = hashes & mask, (hashes >> np.uint64(20)) | np.uint64(1)
    for i in range(PROBES):
        yield ((first + np.uint64(i) * step) & mask).astype(np.int64)


def slice_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(bits // SLICE_BITS)).astype(np.int32)


def pack(hashes: np.ndarray, bits: int, again: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED. Repeats inside ``hashes`` are marked as such and sent once."""
    if not len(hashes):
        return
    values, counts = np.unique(hashes, return_counts=True)
    seen = counts > 1
    where = slice_of(values, bits)
    order = np.argsort(where, kind="stable")
    values, seen, where = values[order], seen[order], where[order]
    edges = np.flatnonzero(np.diff(where)) + 1
    rows: tuple[list, list, list] = ([], [], [])
    for lo, hi in zip([0, *edges], [*edges, len(values)]):
        for at in range(lo, hi, PACK):
            end = min(hi, at + PACK)
            rows[0].append(int(where[at]))
            rows[1].append(values[at:end].tobytes())
            rows[2].append(np.packbits(seen[at:end]).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(rows, _TYPES)], schema=_TYPES)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by slice: set the bits of each slice's hashes, one packed row after the other."""
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    current, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([np.packbits(once).tobytes()], pa.binary()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
            schema=schema,
        )

    for batch in batches:
        for which, packed, again in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if which != current:
                if current is not None:
                    yield done()
                current, once, twice = which, np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)
            hashes = np.frombuffer(packed, np.uint64)
            places = list(_places(hashes))
            before = np.logical_and.reduce([once[p] for p in places])
            before |= np.unpackbits(np.frombuffer(again, np.uint8), count=len(hashes)).astype(bool)
            for p in places:
                twice[p[before]] = True
                once[p] = True
    if current is not None:
        yield done()


@dataclass
class Pair:
    """The two filters as bytes; lives in a broadcast variable."""

    bits: int
    once: np.ndarray
    twice: np.ndarray

    def _has(self, bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        base = slice_of(hashes, self.bits).astype(np.int64) * SLICE_BITS
        at = np.arange(len(hashes))
        for p in _places(hashes):
            # Each probe looks only at what the ones before it have left.
            p = p[at] + base[at]
            at = at[((bitmap[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).astype(bool)]
        out = np.zeros(len(hashes), bool)
        out[at] = True
        return out

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.once, hashes)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.twice, hashes)


def build(packed: DataFrame, bits: int, twice: bool = True) -> Broadcast:
    """Fold rows of PACKED into the filters and broadcast them (2 * bits / 8 bytes at most).

    Readers that ask only for ``seen`` leave the second one out.
    """
    spark = packed.sparkSession
    n = min(partitions(spark), bits // SLICE_BITS)
    slices = (
        packed.repartition(n, "slice").sortWithinPartitions("slice")
        .mapInArrow(_fold, "slice int, once binary, twice binary")
    )
    pair = Pair(bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8 if twice else 0, np.uint8))
    step = SLICE_BITS // 8
    if not twice:
        slices = slices.drop("twice")
    for row in slices.collect():  # as many bytes as the bound allows, whatever the corpus
        at = row["slice"] * step
        pair.once[at:at + step] = np.frombuffer(row["once"], np.uint8)
        if twice:
            pair.twice[at:at + step] = np.frombuffer(row["twice"], np.uint8)
    return spark.sparkContext.broadcast(pair)


def expected_units(df: DataFrame, units) -> int:
    """Sum of a per-row estimate, at least 1."""
    return int(df.select(F.sum(units)).first()[0] or 0) + 1
