"""Byte codecs with no SQL form, for Pandas UDFs: CRC-32C and run-length coding of opaque values."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the Castagnoli polynomial, reflected.
_POLY = 0x82F63B78


#: Bytes that are run through the table side by side.
_LANE = 1024


@functools.lru_cache(maxsize=1)
def _table() -> np.ndarray:
    i = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        i = i >> np.uint32(1) ^ np.where(i & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return i


@functools.lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """(4, 256): what 2**power zero bytes make of each byte of a register; a register is the sum of its bytes'."""
    if power == 0:
        byte, table = np.arange(256, dtype=np.uint32), _table()
        return np.stack([table[byte] if k == 0 else byte << np.uint32(8 * (k - 1)) for k in range(4)])
    half = _zeros(power - 1)
    return np.stack([_through(half, row) for row in half])


def _through(map_: np.ndarray, c: np.ndarray) -> np.ndarray:
    return map_[0][c & 255] ^ map_[1][c >> 8 & 255] ^ map_[2][c >> 16 & 255] ^ map_[3][c >> 24]


def _advanced(c: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    for power in range(int(zeros.max(initial=0)).bit_length()):
        c = np.where(zeros >> power & 1, _through(_zeros(power), c), c)
    return c


def crc32c_many(data: list[bytes], start: int = 0) -> np.ndarray:
    """CRC-32C of each: bytes are cut into lanes, filled with zeros in front, which a register of zero does not notice; all lanes go through
    the table together, a byte at a time, and are then joined by what the bytes that follow make of them."""
    sizes = np.array([len(x) for x in data], np.int64)
    lanes = -(-sizes // _LANE)
    wide = min(_LANE, int(sizes.max(initial=0)))
    grid = np.zeros((int(lanes.sum()), wide), np.uint8)
    if len(grid):
        ends = np.cumsum(lanes)
        flat = grid.reshape(-1)
        for x, end, n in zip(data, ends.tolist(), sizes.tolist(), strict=True):
            flat[end * wide - n : end * wide] = np.frombuffer(x, np.uint8)
    state, table = np.zeros(len(grid), np.uint32), _table()
    for j in range(wide):
        state = state >> np.uint32(8) ^ table[(state ^ grid[:, j]) & 255]
    out, first = np.zeros(len(data), np.uint32), np.cumsum(lanes) - lanes
    for k in range(int(lanes.max(initial=0))):
        more = lanes > k
        out[more] = _advanced(out[more], np.full(more.sum(), wide)) ^ state[first[more] + k]
    begun = _advanced(np.full(len(data), start ^ 0xFFFFFFFF, np.uint32), sizes)
    return out ^ begun ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes, start: int = 0) -> int:
    """crc32c(a + b) == crc32c(b, crc32c(a))."""
    return int(crc32c_many([data], start)[0])


def rle_encode(data: bytes) -> bytes:
    """Runs of four or more, and every 0xFF, become 0xFF, count (255 at most), byte; all else stays."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n, byte = np.diff(np.append(at, len(a))), a[at]
    parts = -(-n // 255)
    size = np.full(parts.sum(), 255)
    size[np.cumsum(parts) - 1] = n - 255 * (parts - 1)
    byte = np.repeat(byte, parts)
    coded = (size > 3) | (byte == 255)
    wide = np.where(coded, 3, size)
    out, first = np.repeat(byte, wide), (np.cumsum(wide) - wide)[coded]
    out[first], out[first + 1] = 255, size[coded]
    return out.tobytes()


def rle_decode(data: bytes) -> bytes:
    out, at = [], 0
    while (mark := data.find(255, at)) >= 0:
        if mark + 2 >= len(data):
            raise ValueError("a run is cut short")
        out += (data[at:mark], data[mark + 2 : mark + 3] * data[mark + 1])
        at = mark + 3
    return b"".join([*out, data[at:]])


@F.pandas_udf(T.BinaryType())
def rle_compress(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else rle_encode(bytes(x)))


@F.pandas_udf(T.BinaryType())
def rle_uncompress(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else rle_decode(bytes(x)))


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    there = data.notna()
    out = pd.Series([None] * len(data), dtype="Int64")
    out[there.to_numpy()] = crc32c_many([bytes(x) for x in data[there]]).astype("int64")
    return out
