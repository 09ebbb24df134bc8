"""Codecs as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LOG_BLOCK, LOG_HEADER


def pack_trailer(seq: Column, type_: Column) -> Column:
    return F.shiftleft(seq, 8).bitwiseOR(type_.cast("long"))


def unpack_trailer(trailer: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(trailer, 8), trailer.bitwiseAND(F.lit(255))


def internal_key(user_key: Column, trailer: Column) -> Column:
    """Bytes of a key and its little-endian trailer."""
    return F.concat(user_key.cast("binary"), F.unhex(fixed_hex(trailer, 8)))


def user_key(ikey: Column) -> Column:
    """Null where there is no room for a trailer."""
    return F.when(F.octet_length(ikey) >= 8, F.substring(ikey, F.lit(1), F.octet_length(ikey) - 8))


def byte_hex(value: Column) -> Column:
    return F.lpad(F.hex(value.bitwiseAND(F.lit(255))), 2, "0")


def fixed_hex(value: Column, width: int) -> Column:
    """Little-endian bytes, as hex."""
    return F.concat(*[byte_hex(F.shiftrightunsigned(value, 8 * i)) for i in range(width)])


def varint_length(value: Column) -> Column:
    """Bytes of the LEB128 form of a number that is not negative."""
    out = F.lit(1)
    for i in range(1, 9):
        out = out + (value >= F.lit(1 << (7 * i))).cast("int")
    return out


def varint_hex(value: Column) -> Column:
    """LEB128 bytes, as hex: seven bits each, the lowest first, the top bit set on all but the last."""
    n = varint_length(value)
    parts = [F.when(F.lit(i) < n, byte_hex(F.shiftrightunsigned(value, 7 * i).bitwiseAND(F.lit(127)) + F.when(F.lit(i + 1) < n, 128).otherwise(0))).otherwise("") for i in range(9)]
    return F.concat(*parts)


def varint_decode(hexed: Column) -> Column:
    """The number, or null where the bytes end too early or are too many (over nine)."""
    n = (F.length(hexed) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("long")
    total, ended, fine = F.lit(0).cast("long"), F.lit(False), F.lit(False)
    for i in range(9):
        here = (F.lit(i) < n) & ~ended
        total = F.when(here, total.bitwiseOR(F.shiftleft(byte(i).bitwiseAND(F.lit(127)), 7 * i))).otherwise(total)
        last = here & (byte(i) < 128)
        fine, ended = fine | last, ended | last
    return F.when(fine, total)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share at their start; null counts as empty."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(F.size(differ) == 0, n).otherwise(F.element_at(differ, 1) - 1)


def rle_bytes(run: Column) -> Column:
    """Bytes of a run of one byte other than 0xFF: three for each full 255, then three for four or more, else the bytes themselves."""
    rest = F.pmod(run, F.lit(255))
    return F.floor(run / 255) * 3 + F.when(rest >= 4, 3).otherwise(rest)


def fragments(size: Column, block: int = LOG_BLOCK, header: int = LOG_HEADER) -> Column:
    """Log fragments of a record that starts a block; an empty record has one."""
    return F.greatest(F.ceil(size / (block - header)), F.lit(1)).cast("long")


def laid_out(records: pd.DataFrame) -> pd.DataFrame:
    """Records (doc_id, size, log) of one log, in the order of doc_id: where each one's first header stands, and its fragments. A block that
    has no room for a header is left."""
    at, starts, counts = 0, [], []
    records = records.sort_values("doc_id")
    for size in records["size"].tolist():
        room = LOG_BLOCK - at % LOG_BLOCK
        if room < LOG_HEADER:
            at, room = at + room, LOG_BLOCK
        n = 1 + max(0, -(-(size - (room - LOG_HEADER)) // (LOG_BLOCK - LOG_HEADER)))
        starts.append(at)
        counts.append(n)
        at += size + n * LOG_HEADER
    return records[["doc_id", "log"]].assign(start=starts, fragments=counts)


#: Seed and multiplier of the filter's hash, and its two shifts.
_SEED, _TIMES, _SHIFT, _LAST_SHIFT = 0xBC9F1D34, 0xC6A4A793, 16, 24
_U32 = 0xFFFFFFFF


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), x evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _times32(x: Column, by: int) -> Column:
    """The product's lowest 32 bits, of numbers of 32 bits: by halves, as a long product would overflow."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(by), F.shiftrightunsigned(x, 16) * F.lit(by)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_U32))


def filter_hash(key: Column) -> Column:
    """The bloom filter's 32-bit hash of bytes, as a long: little-endian words of four are added, multiplied and folded in turn, then what
    is left over."""
    hexed = F.hex(key.cast("binary"))
    n = F.octet_length(key)

    def little(start: Column, size: int) -> Column:
        return F.conv(F.concat(*[F.substring(hexed, 2 * (start + i) + 1, F.lit(2)) for i in reversed(range(size))]), 16, 10).cast("long")

    def folded(h: Column, word: Column, shift: int) -> Column:
        return _let((h + word).bitwiseAND(F.lit(_U32)), lambda x: _let(_times32(x, _TIMES), lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, shift))))

    words = F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (n / 4).cast("int") - 1)), lambda i: little(4 * i, 4))).otherwise(F.array().cast("array<long>"))
    h = F.aggregate(words, F.lit(_SEED).cast("long").bitwiseXOR(_times32(n.cast("long"), _TIMES)), lambda h, w: folded(h, w, _SHIFT))
    rest, start = n % 4, n - n % 4
    left = F.when(rest == 3, little(start, 3)).when(rest == 2, little(start, 2)).when(rest == 1, little(start, 1))
    return _let(h, lambda h: F.when(rest == 0, h).otherwise(folded(h, left, _LAST_SHIFT)))


def bloom_probes(key: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a key: its hash, then steps of the hash turned right by 17 bits."""
    def probes(h: Column) -> Column:
        step = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(_U32))
        return _let(step, lambda step: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod((h + i.cast("long") * step).bitwiseAND(F.lit(_U32)), F.lit(bits))))

    return _let(filter_hash(key), probes)


def bloom_shape(keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """Bits (64 at least, whole bytes) and hashes (1 to 30) of a filter."""
    return -(-max(64, keys * bits_per_key) // 8) * 8, min(30, max(1, int(bits_per_key * 0.69)))


def shard_of(key: Column, shards: int = 16) -> Column:
    """By the first 32 bits of a digest, which any engine has."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards))


def char_at(x: Column, i: Column) -> Column:
    """The character at an index from 0; null where there is none."""
    return F.when((i >= 0) & (i < F.length(x)), F.substring(x, i + 1, F.lit(1)))


def to_text(x: Column) -> Column:
    """Bytes as text, up to the first zero byte."""
    return F.substring_index(F.decode(x, "UTF-8"), "\0", 1)


def compare(a: Column, b: Column) -> Column:
    """-1, 0, 1 by unsigned bytes, a proper prefix first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def remove_prefix(x: Column, prefix: str) -> Column:
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def status_text(*parts: Column) -> Column:
    """Messages joined as `a: b`, without those that are null."""
    return F.concat_ws(": ", *parts)
