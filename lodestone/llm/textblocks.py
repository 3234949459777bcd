"""Numpy kernels over the UTF-8 bytes of many texts at once: words, lines and hashes of byte ranges.

Every kernel works on a block of whole texts (half a megabyte together, or one longer text), so memory
follows the longest text and never the partition.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

#: White space of all word rules here: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK = 1 << 19
U = np.uint64
_random = np.random.default_rng(0x5EED)
_TABLES = _random.integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(U) * U(2) + U(1)
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]

#: Multipliers of the words of an n-gram.
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.int64).astype(U) * U(2) + U(1)


def rows_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(rows: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Slices of ``rows`` of at most ``limit`` bytes, or of one row."""
    lo, size = 0, 0
    for i, row in enumerate(rows):
        if size and size + len(row) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(row) + 1
    if lo < len(rows):
        yield lo, len(rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse.

    Functions travel to executors by value, each task with globals of its own. The powers are kept with the process instead, so
    tasks neither carry nor recompute them.
    """
    powers = sys.modules.setdefault("_lodestone_powers", ModuleType("_lodestone_powers")).__dict__.setdefault("kept", {})
    if which not in powers or len(powers[which][0]) < n:
        size = max(n, BLOCK + 4096)
        base = _BASES[which]
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        powers[which] = np.cumprod(up), np.cumprod(down)
    return powers[which]


def prefix_hashes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums from which ``range_hash`` takes the hash of any byte range in constant time."""
    up, _ = _powers(which, len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLES[which][data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the bytes from ``starts`` to ``ends``; equal bytes have equal hashes wherever they stand."""
    _, down = _powers(which, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts.

    ``data`` holds them with one space after each; word i is ``data[starts[i]:ends[i]]``, and text t has the
    words ``offsets[t]`` to ``offsets[t + 1]``.
    """

    def __init__(self, rows: list[bytes], lower: bool = False):
        raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
        if lower:
            raw = LOWER[raw]
        space = SPACE[raw]
        after = np.zeros(len(raw), bool)
        after[1:] = space[1:] & ~space[:-1]
        self.raw, self.space = raw, space
        self.data = np.where(space, np.uint8(32), raw)[~space | after]
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if len(self.ends) else np.zeros(0, np.int64)
        self.row_ends = np.cumsum([len(r) + 1 for r in rows])
        self.offsets = np.concatenate([[0], np.searchsorted(np.flatnonzero(after), self.row_ends)]).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hashes(self.data), self.starts, self.ends)

    def windows(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word and text of each window of ``size`` words; with ``short``, a text of fewer words has one window of all."""
        n = self.counts
        have = np.maximum(n - size + 1, (n > 0).astype(np.int64) if short else 0)
        text = np.repeat(np.arange(len(n)), have)
        first = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have) + self.offsets[:-1][text]
        return first, np.minimum(first + size, self.offsets[1:][text]) - 1, text


def gram_hashes(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` following word hashes."""
    total = words[first] * _PLACE[0]
    for j in range(1, size):
        total += words[first + j] * _PLACE[j]
    return mix(total)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string, signed 64-bit numbers as 32-bit ones where they fit."""
    small = np.iinfo(np.int32)
    arrays = [a.astype(np.int32) if a.dtype == np.int64 and len(a) and small.min <= a.min() and a.max() <= small.max else a for a in arrays]
    heads = [f"{a.dtype.str}:{len(a)}" for a in arrays]
    return ";".join(heads).encode() + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    at = blob.index(b"\n") + 1
    out = []
    for head in blob[: at - 1].decode().split(";"):
        kind, n = head.split(":")
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * kind.itemsize
    return out


def unpack_all(blobs: list[bytes]) -> list[np.ndarray]:
    """The arrays of many blobs, each joined with its like."""
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of any object, class included, so executors need no copy of this package. Call the result once in each task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
