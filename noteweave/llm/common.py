"""Shared plumbing: cutting lineage in shared storage and walking Arrow batches."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, scratch

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost
    executor costs a re-read and not a recomputation."""
    return cut(df)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return scratch(spark, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def text_bytes(c: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(c).cast("binary"), F.lit(b""))


def give_back() -> None:
    """Return freed memory to the system, so that a worker that goes from one large block
    to the next does not keep the most that it ever had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def binary_column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a binary Arrow array, without a copy; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_binary(arr.type) and not pa.types.is_binary(arr.type):
        arr = arr.cast(pa.binary())
    wide = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offsets, wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about limit; each has one item at least."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    i, n = 0, len(sizes)
    while i < n:
        j = int(np.searchsorted(total, total[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """concatenate(arange(s, s + n) for each pair)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of a uint64 array (in a new array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, in place; x: uint64."""
    high = x >> np.uint64(61)
    x &= _P
    x += high
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for a and b below it: halves of 31 and 30 bits."""
    half, low, part = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a0 * b1 + a1 * b0  # times 2^31
    out = a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + a0 * b0
    return _folded(_folded(out) + ((middle & part) << half))


class PrimeHash:
    """Hashes of slices of an array of small numbers, for comparison with each other: values
    of a polynomial modulo 2^61 - 1 at a point that each worker draws at random.  Two
    different slices of n numbers agree with a probability of n / 2^61 at most, whatever
    the numbers are, so no text can be made to collide."""

    BASE = np.uint64(int.from_bytes(os.urandom(8), "little") % (PRIME - 1000) + 500)
    _power = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> np.ndarray:
        while len(cls._power) < n:
            step = _times(cls._power[-1:], np.array([cls.BASE]))
            cls._power = np.concatenate((cls._power, _times(cls._power, step)))
        return cls._power[:n]

    def __init__(self, values: np.ndarray):
        """values: unsigned numbers below 2^16."""
        n, half, step = len(values), np.uint64(31), 1 << 14  # steps that stay in the cache
        self.power = self._powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        for a in range(0, n, step):
            power, out = self.power[a : min(n, a + step)], self.sums[a + 1 : a + 1 + step]
            v = values[a : a + step].astype(np.uint64) + np.uint64(1)
            middle = v * (power >> half)
            terms = _folded(((middle & np.uint64((1 << 30) - 1)) << half) + (middle >> np.uint64(30)) + v * (power & np.uint64((1 << 31) - 1)))
            low = np.cumsum(terms & np.uint64(0xFFFFFFFF), dtype=np.uint64)
            high = np.cumsum(terms >> np.uint64(32), dtype=np.uint64)  # times 2^32, so that bits from the 29th on come round
            out[:] = ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29)) + low + self.sums[a]
            _folded(out)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Brought to one degree by the power that each start lacks to the array's length."""
        own = _folded(self.sums[end] + (_P - self.sums[start]))
        return mix64(_times(own, self.power[len(self.sums) - 1 - start]))


class RollingHash:
    """Hashes of any slice of one array from prefix sums of a polynomial modulo 2**64.

    Fast, but texts can be made to collide: for finding candidates that are then compared.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._power) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, base in (("_power", cls.BASE), ("_inverse", cls.INVERSE)):
                out = np.full(size, np.uint64(base), np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls._power[:n], cls._inverse[:n]

    def __init__(self, values: np.ndarray):
        """values: uint64, one for each position, already well mixed."""
        n = len(values)
        power, self.inverse = self._tables(n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * power[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, width: int) -> np.ndarray:
        """slices() of each run of `width` numbers."""
        return mix64((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])
