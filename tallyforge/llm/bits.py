"""A bit array of 64-bit hashes, built on the executors.

Two bits or more are set for each hash.  The array is sized to the number of hashes, at
least RATIO bits for each, and has at most 2^27 bits, 16 MB; where the hashes
would need more, none is built, as it would let nearly everything pass.  Each
task folds its hashes and sends of each slice what is shorter, the slice or the
numbers of its bits, so that all tasks together send a bounded number of bytes
however many they are.  A second array may tell which bits were set twice.  Only the finished array reaches the driver, to be
broadcast.  It answers "certainly absent" or "maybe present", so a probe side may
drop what is certainly absent before a shuffle; nothing is ever lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame

MOST = 1 << 27
RATIO = 2
AIM = 48
SLICES = 64
_FACTORS = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_HELD = 1 << 23


def bits_for(n: int, ratio: int = RATIO) -> int | None:
    """Bits of the array for ``n`` hashes, a power of two; None where even the largest has fewer than ``ratio`` bits for each."""
    if n * ratio > MOST:
        return None
    return min(MOST, 1 << max(16, (n * AIM).bit_length()))


def bit_positions(hashes: np.ndarray, bits: int, marks: int = 2) -> list[np.ndarray]:
    """``marks`` bit numbers of each uint64 hash."""
    shift = np.uint64(65 - bits.bit_length())
    h = hashes.astype(np.uint64, copy=False)
    return [(h if i == 0 else h * _FACTORS[i]) >> shift for i in range(marks)]


def packed(at: list[np.ndarray], bits: int) -> np.ndarray:
    """A bit array in which the bits of these numbers are set."""
    flags = np.zeros(bits, bool)
    for numbers in at:
        flags[numbers] = True
    return np.packbits(flags, bitorder="little")


def shortened(numbers: np.ndarray, width: int) -> bytes:
    """Numbers in order below ``width``: compressed steps from one to the next, or the bit array itself where that is shorter."""
    steps = np.diff(numbers, prepend=np.uint32(0)).astype(np.uint32)
    made = len(numbers).to_bytes(4, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
    return b"s" + made if len(made) < width // 8 else b"d" + packed([numbers], width).tobytes()


def lengthened(data: bytes, width: int) -> np.ndarray:
    """The bit array of what ``shortened`` made."""
    if data[:1] == b"d":
        return np.frombuffer(data[1:], np.uint8)
    n = int.from_bytes(data[1:5], "little")
    planes = np.frombuffer(pa.decompress(data[5:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return packed([np.cumsum(planes.T.copy().view(np.uint32).ravel(), dtype=np.uint64).astype(np.uint32)], width)


def maybe_present(array: np.ndarray, hashes: np.ndarray, marks: int = 2) -> np.ndarray:
    """A mask over the hashes: False where a hash was certainly never set."""
    left = np.arange(len(hashes))
    shift = np.uint64(65 - (len(array) * 8).bit_length())
    for i in range(marks):
        at = (hashes[left] if i == 0 else hashes[left] * _FACTORS[i]) >> shift
        left = left[((array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
    mask = np.zeros(len(hashes), bool)
    mask[left] = True
    return mask


def column(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The whole numbers of a batch's first column, as hashes."""
    return [batch.column(0).to_numpy().view(np.uint64)]


def _united(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers in order, those that occur more than once)."""
    numbers = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint32)
    new = np.ones(len(numbers), bool)
    new[1:] = numbers[1:] != numbers[:-1]
    return numbers[new], np.unique(numbers[~new])


def build(source: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], n: int, twice: bool = False, marks: int = 2, ratio: int = RATIO) -> Broadcast | None:
    """The bit array of the ``n`` hashes that ``hashes_of`` finds in the batches of ``source``, ``marks`` bits for each, as a broadcast of uint8; None where they are too many.

    With ``twice``, a pair of arrays, the second of the bits that more than one hash has set: a hash that is in it was given at least
    twice, or its bits by others.
    """
    bits = bits_for(n, ratio)
    if bits is None:
        return None
    width = bits // SLICES

    def fold(batches):
        held, ones, twos, size = [], [], [], 0

        def gather():
            one, two = _united([*ones, *held])
            return [one], [_united([*twos, two])[0]]

        for batch in batches:
            for hashes in hashes_of(batch):
                held += [at.astype(np.uint32) for at in bit_positions(hashes, bits, marks)]
                size += marks * len(hashes)
            if size > _HELD:
                ones, twos = gather()
                held, size = [], 0
        ones, twos = gather()
        rows = []
        for numbers, again in ((ones[0], False), (twos[0], True)) if twice else ((ones[0], False),):
            cuts = np.searchsorted(numbers, np.arange(SLICES + 1, dtype=np.uint64) * np.uint64(width))
            rows += [(i, again, shortened(numbers[a:b] - np.uint32(i * width), width)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["slice", "again", "bits"])

    def either(batches):
        """The slices of one task, or-ed."""
        once: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        none = np.zeros(width // 8, np.uint8)
        for batch in batches:
            for i, again, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                part = lengthened(data, width)
                if again:
                    more[i] = more.get(i, none) | part
                else:
                    more[i] = more.get(i, none) | (once.get(i, none) & part)
                    once[i] = once.get(i, none) | part
        rows = [(i, False, p) for i, p in once.items()] + ([(i, True, p) for i, p in more.items() if p.any()] if twice else [])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["slice", "again", "bits"])

    schema = "slice int, again boolean, bits binary"
    arrays = [np.zeros(bits // 8, np.uint8) for _ in range(1 + twice)]
    for row in source.mapInArrow(fold, schema).repartition("slice").mapInArrow(either, schema).toLocalIterator():
        arrays[row["again"]][row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return source.sparkSession.sparkContext.broadcast(tuple(arrays) if twice else arrays[0])


def only_present(df: DataFrame, hashed: Column, present: Broadcast | None) -> DataFrame:
    """The rows whose hash, a whole number, may be in the array; all of them without one."""
    if present is None:
        return df
    names = df.columns

    def run(batches):
        for batch in batches:
            mask = maybe_present(present.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(mask)).columns[:-1], names=names)

    return df.select("*", hashed.alias("_hash")).mapInArrow(run, df.schema)
