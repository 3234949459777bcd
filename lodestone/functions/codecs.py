"""Integer codecs of postings as columns: encoded sizes, encoded bytes and decoding.

Sizes of single numbers are JVM expressions. Whole lists are encoded and decoded by functions over all numbers of a batch at once, as columns (Arrow
functions) or for ``operators.compression``; nothing loops over values. Lists must be ascending, distinct and not negative where they are ids, and at least 1 where they are frequencies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bit_length(v: Column) -> Column:
    """Bits of a number without leading zeros; 1 for 0."""
    return F.length(F.bin(v))


def gaps(ids: Column) -> Column:
    """The first id, then the differences."""
    return F.transform(ids, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(ids, i - 1)))


def _flat(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers (or bytes) of a column of lists (or byte strings), and where each row's begin, with their end; a null row has none."""
    if pa.types.is_binary(data.type) or pa.types.is_large_binary(data.type):
        data = data.cast(pa.binary())
        edge = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        held = data.buffers()[2]
        values = np.frombuffer(held, np.uint8)[edge[0] : edge[-1]] if held is not None else np.zeros(0, np.uint8)
    else:
        edge = data.offsets.to_numpy().astype(np.int64)
        values = data.values.slice(edge[0], edge[-1] - edge[0]).to_numpy(zero_copy_only=False)
    edge = edge - edge[0]
    if data.null_count:
        # a null row may still cover values
        size = np.where(data.is_null().to_numpy(zero_copy_only=False), 0, np.diff(edge))
        values = values[np.repeat(edge[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        edge = np.append(0, np.cumsum(size))
    return values, edge


def _column(data: pa.Array, values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Rows of ``values`` cut at ``edge``, as lists or, of bytes, as byte strings; null where ``data`` is."""
    offsets = pa.array(edge.astype(np.int32))
    if values.dtype == np.uint8:
        out = pa.BinaryArray.from_buffers(pa.binary(), len(edge) - 1, [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())])
    else:
        out = pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64)))
    return pa.compute.if_else(data.is_valid(), out, pa.scalar(None, out.type)) if data.null_count else out


def _arrow(kind: T.DataType, work):
    """An Arrow function of ``work`` on the flat values of a batch and their edges."""

    def run(data: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        return _column(data, *work(*_flat(data)))

    return F.arrow_udf(run, kind)


_LIST = T.ArrayType(T.LongType())


def _running(values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of each row."""
    total = np.append(0, np.cumsum(values.astype(np.int64)))
    return total[1:] - np.repeat(total[edge[:-1]], np.diff(edge)), edge


_sums = _arrow(_LIST, _running)


def sums(parts: Column) -> Column:
    """Running sums: what ``gaps`` was made of."""
    return _sums(parts)


def vb_size(v: Column) -> Column:
    """Bytes of one variable-byte number."""
    return F.ceil(bit_length(v) / 7).cast("bigint")


def gamma_bits(v: Column) -> Column:
    """Bits of one Elias-gamma number."""
    return (2 * bit_length(v) - 1).cast("bigint")


def _hex_byte(v: Column) -> Column:
    return F.lpad(F.hex(v), 2, "0")


def vb_hex(v: Column) -> Column:
    """One number as base-128 digits, most significant first, 128 added to the last, in hexadecimal."""
    n = vb_size(v).cast("int")
    digit = lambda i: F.call_function("shiftright", v, (n - i) * 7).bitwiseAND(F.lit(127))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _hex_byte(F.when(i == n, digit(i) + 128).otherwise(digit(i)))), "")


def gamma_string(v: Column) -> Column:
    """One number as Elias-gamma bits: a zero for each bit behind the first, then the number."""
    bits = F.bin(v)
    return F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits)


def _narrow(width: int):
    """Little-endian numbers of ``width`` bytes."""
    return lambda values, edge: (np.frombuffer(values.astype(f"<{'i' if width == 8 else 'u'}{width}").tobytes(), np.uint8), edge * width)


_standard_encode = {w: _arrow(T.BinaryType(), _narrow(w)) for w in (4, 8)}


def standard_encode(values: Column, width: int = 8) -> Column:
    """Little-endian numbers of ``width`` bytes, without gaps."""
    return _standard_encode[width](values)


def _wide(width: int):
    """Numbers of ``width`` little-endian bytes."""
    return lambda data, edge: (np.frombuffer(data.tobytes(), f"<{'i' if width == 8 else 'u'}{width}").astype(np.int64), edge // width)


_standard_decode = {w: _arrow(_LIST, _wide(w)) for w in (4, 8)}


def standard_decode(data: Column, width: int = 8) -> Column:
    return _standard_decode[width](data)


def gap_numbers(values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first number of each row, then the differences."""
    out = np.diff(values.astype(np.int64), prepend=0)
    first = edge[:-1][np.diff(edge) > 0]
    out[first] = values[first]
    return out, edge


def vb_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each variable-byte number."""
    return -(-_bits(values) // 7)


def _vb_bytes(values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as base-128 digits, most significant first, 128 added to the last."""
    size = vb_sizes(values)
    end = np.append(0, np.cumsum(size))
    out = np.zeros(end[-1], np.uint8)
    out[end[1:] - 1] = (values & 127) | 128
    for k in range(1, int(size.max(initial=1))):
        long = size > k
        out[end[1:][long] - 1 - k] = (values[long] >> (7 * k)) & 127
    return out, end[edge]


_vbe_encode_tf = _arrow(T.BinaryType(), _vb_bytes)
_vbe_encode = _arrow(T.BinaryType(), lambda values, edge: _vb_bytes(*gap_numbers(values, edge)))


def vbe_encode_tf(values: Column) -> Column:
    return _vbe_encode_tf(values)


def vbe_encode(ids: Column) -> Column:
    return _vbe_encode(ids)


def _vb_numbers(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A digit of 128 or more is the last of its number; digits are weighed by their places before it and added up."""
    last = np.flatnonzero(data >= 128)
    if not len(last):
        return np.zeros(0, np.int64), edge * 0
    first = np.append(0, last[:-1] + 1)
    place = np.repeat(last, last + 1 - first) - np.arange(last[-1] + 1)
    digits = (data[: last[-1] + 1] & 127).astype(np.int64) << (7 * place)
    return np.add.reduceat(digits, first), np.searchsorted(last, edge)


_vbe_decode_tf = _arrow(_LIST, _vb_numbers)


def vbe_decode_tf(data: Column) -> Column:
    return _vbe_decode_tf(data)


_vbe_decode = _arrow(_LIST, lambda data, edge: _running(*_vb_numbers(data, edge)))


def vbe_decode(data: Column) -> Column:
    return _vbe_decode(data)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each positive number without leading zeros."""
    out = np.zeros(len(values), np.int64)
    rest = values.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.int64(1) << step
        out[high] += step
        rest = np.where(high, rest >> step, rest)
    return out + 1


def _gamma_bytes(values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as Elias-gamma bits, each row filled up to whole bytes."""
    if len(values) and values.min() < 1:
        raise ValueError("Elias-gamma codes numbers from 1 on")
    width = _bits(values)
    ahead = np.append(0, np.cumsum(2 * width - 1))
    own = ahead[edge[1:]] - ahead[edge[:-1]]
    size = -(-own // 8)
    out = np.append(0, np.cumsum(size))
    # the last bit of each number
    end = ahead[1:] - 1 + np.repeat(8 * out[:-1] - ahead[edge[:-1]], np.diff(edge))
    bits = np.zeros(8 * out[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        long = width > k
        bits[end[long] - k] = (values[long] >> k) & 1
    return np.packbits(bits), out


_gamma_encode = _arrow(T.BinaryType(), _gamma_bytes)


def _raised(values: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap, edge = gap_numbers(values, edge)
    return gap + 1, edge


_elias_encode = _arrow(T.BinaryType(), lambda values, edge: _gamma_bytes(*_raised(values, edge)))


def elias_encode_tf(values: Column) -> Column:
    return _gamma_encode(values)


def elias_encode(ids: Column) -> Column:
    """Gaps, each raised by one since ids start at 0."""
    return _elias_encode(ids)


def _gamma_numbers(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each row; trailing zeros are padding.

    Where a number starts, the next one bit tells where it ends. The starts of all rows are followed together by doubling: after each
    turn twice as many numbers are reached from those known.
    """
    bits = np.unpackbits(data)
    n = len(bits)
    one = np.where(bits > 0, np.arange(n), n)
    one = np.minimum.accumulate(one[::-1])[::-1]
    row_end = np.repeat(8 * edge[1:], 8 * np.diff(edge))
    # from each bit, the start of the number after one that starts there; n where none does
    jump = np.append(np.where(one < row_end, np.minimum(2 * one - np.arange(n) + 1, n), n), n)
    reached = np.zeros(n + 1, bool)
    # a number may end its row, and the next row begins there by itself
    reached[8 * edge[:-1][np.diff(edge) > 0]] = True
    while True:
        found = jump[reached[:-1].nonzero()[0]]
        before = int(reached.sum())
        reached[found] = True
        if int(reached.sum()) == before:
            break
        jump = jump[jump]
    start = np.flatnonzero(reached[:-1])
    start = start[one[start] < row_end[start]]
    width = one[start] - start + 1
    out = np.zeros(len(start), np.int64)
    for k in range(int(width.max(initial=0))):
        long = width > k
        out[long] |= bits[(one[start] + width - 1)[long] - k].astype(np.int64) << k
    return out, np.searchsorted(start, 8 * edge)


_gamma_decode = _arrow(_LIST, _gamma_numbers)


def _lowered(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raised, edge = _gamma_numbers(data, edge)
    return _running(raised - 1, edge)


_elias_decode = _arrow(_LIST, _lowered)


def elias_decode_tf(data: Column) -> Column:
    """Trailing zeros are padding."""
    return _gamma_decode(data)


def elias_decode(data: Column) -> Column:
    return _elias_decode(data)


@dataclass(frozen=True)
class Codec:
    """Encoders and decoders of a list of ids and of a list of frequencies, and bits per number of each."""

    encode: object
    decode: object
    encode_tf: object
    decode_tf: object
    #: of a gap (of the first id: the id), and of a frequency
    gap_bits: object
    tf_bits: object
    #: the same on the flat numbers, or bytes, of many lists and their edges
    pack: object
    unpack: object
    pack_tf: object
    unpack_tf: object
    gap_bits_of: object
    tf_bits_of: object


_FULL = lambda v: np.full(len(v), 64, np.int64)
_STANDARD = (_narrow(8), _wide(8), _narrow(8), _wide(8), _FULL, _FULL)
_VBE = (lambda v, e: _vb_bytes(*gap_numbers(v, e)), lambda v, e: _running(*_vb_numbers(v, e)), _vb_bytes, _vb_numbers, lambda v: 8 * vb_sizes(v), lambda v: 8 * vb_sizes(v))
_ELIAS = (lambda v, e: _gamma_bytes(*_raised(v, e)), _lowered, _gamma_bytes, _gamma_numbers, lambda v: 2 * _bits(v + 1) - 1, lambda v: 2 * _bits(v) - 1)
CODECS = {
    "standard": Codec(standard_encode, standard_decode, standard_encode, standard_decode, lambda v: F.lit(64).cast("bigint"), lambda v: F.lit(64).cast("bigint"), *_STANDARD),
    "vbe": Codec(vbe_encode, vbe_decode, vbe_encode_tf, vbe_decode_tf, lambda v: 8 * vb_size(v), lambda v: 8 * vb_size(v), *_VBE),
    "elias": Codec(elias_encode, elias_decode, elias_encode_tf, elias_decode_tf, lambda v: gamma_bits(v + 1), gamma_bits, *_ELIAS),
}


def codec(name: str) -> Codec:
    """A codec by name."""
    if name not in CODECS:
        raise ValueError(f"unknown compression {name!r}; choose from {', '.join(CODECS)}")
    return CODECS[name]
