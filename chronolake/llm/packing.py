"""Harmonic packing: pieces in reciprocal-capacity classes, each class's bins filled with a fixed count, workers independent."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bpe
from .common import releasing, written

CAPACITY = 2048
#: Classes 1 .. CLASSES hold pieces of (capacity / (k + 1), capacity / k]; shorter pieces share one class, whose bins are filled in turn.
CLASSES = 64
#: Of a bin of like pieces, how much may stay empty before a piece is cut to fit its class.
SLACK = 0.02
#: Workers whose leftover pieces meet in one task of the next round.
FAN_IN = 8
#: Pieces never leave a worker's round in the same sequence id space: (round, worker, number).
_WORKER_BITS, _NUMBER_BITS = 20, 37
PIECES = "_row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def class_of(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> int:
    """k with capacity / (k + 1) < length <= capacity / k; classes + 1 for all that is shorter."""
    return min(capacity // length, classes + 1)


def cuts(length: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[int]:
    """Piece lengths of a document: whole bins, then the longest reciprocals of the capacity, until what is left fills its class well."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = class_of(rest, capacity, classes)
        if k > classes or capacity - k * rest <= slack * capacity:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


class Worker:
    """Open bins of one worker: at most one for each class, each with fewer pieces than its count."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.small = 0  # tokens in the open bin of the class of short pieces

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the bin that this piece (row, start, length, crc, doc_tokens) completes, if it does."""
        k = class_of(piece[2], self.capacity, self.classes)
        done: list[tuple] = []
        if k > self.classes:
            if self.small + piece[2] > self.capacity:
                done, self.small = self.close(self.open.pop(k)), 0
            self.open.setdefault(k, []).append(piece)
            self.small += piece[2]
            return done
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self.close(self.open.pop(k)) if len(bin_) == k else done

    def close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((*p, self.next, offset))
            offset += p[2]
        self.next += 1
        return out

    def leftovers(self) -> list[tuple]:
        return [p for pieces in self.open.values() for p in pieces]


def best_fit(pieces: list[tuple], first: int, capacity: int = CAPACITY) -> list[tuple]:
    """The last leftovers, longest first, each into the fullest bin that has room; rooms are kept by size, so this is near-linear."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, used = [], []
    for p in sorted(pieces, key=lambda p: (-p[2], p[0] is None, str(p[0]), p[1])):
        room = next((r for r in range(p[2], capacity + 1) if rooms[r]), 0)
        if room:
            b = rooms[room].pop()
        else:
            b, room = len(used), capacity
            used.append(0)
        out.append((*p, first + b, used[b]))
        used[b] += p[2]
        rooms[room - p[2]].append(b)
    return out


def _number(step: int) -> int:
    from pyspark import TaskContext

    return (step << (_WORKER_BITS + _NUMBER_BITS)) + (TaskContext.get().partitionId() << _NUMBER_BITS)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 1) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece, each id of each document in one piece.

    A document's ids are its text's and `end`; null or empty text gives `end` alone. Every worker cuts, classes and packs what it reads,
    in one pass and without a shuffle, and keeps fewer than sum(1 .. CLASSES) open pieces. Those leftovers (metadata only, no ids) are
    packed again by ever fewer workers, eight to one, and what the last one leaves goes by best fit, so only the last few sequences of
    the whole corpus are padded. Repeated rows are packed as rows; null keys stay; other columns are dropped.
    sequence_id is unique, not gapless; offsets within a sequence are gapless from 0.
    """
    names = [key, *[c.split(" ")[0] for c in PIECES.split(", ")[1:]]]
    schema = PIECES.replace("_row long", f"`{key}` {docs.schema[key].dataType.simpleString()}")
    kinds = [to_arrow_type(docs.schema[key].dataType), *[pa.int64()] * (len(names) - 1)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = bpe.load(tokenizer).encode, Worker(_number(0), capacity)
        for batch in batches:
            out = []
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(body) if body else []
                ids.append(end)
                raw, n, at = np.asarray(ids, "<u4"), len(ids), 0
                for length in cuts(n, capacity):
                    out += worker.add((row, at, length, zlib.crc32(raw[at : at + length]), n))
                    at += length
            yield _batch(out, names, kinds)
        yield _batch([(*p, -1, -1) for p in worker.leftovers()], names, kinds)

    source = docs.select(F.col(key), F.col(text))
    workers = max(1, docs.rdd.getNumPartitions())
    if workers >= 2**_WORKER_BITS:
        raise ValueError(f"{workers} input partitions; sequence ids have room for {2**_WORKER_BITS}")
    done = []
    step = written(source.mapInArrow(releasing(first), schema))
    while True:
        done.append(step.where("sequence_id >= 0"))
        left = step.where("sequence_id < 0")
        workers = -(-workers // FAN_IN)
        number, last = len(done), workers == 1

        def again(batches: Iterator[pa.RecordBatch], number: int = number, last: bool = last) -> Iterator[pa.RecordBatch]:
            worker = Worker(_number(number), capacity)
            for batch in batches:
                out = []
                for p in zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True):
                    out += worker.add(p)
                yield _batch(out, names, kinds)
            rest = worker.leftovers()
            yield _batch(best_fit(rest, worker.next, capacity) if last else [(*p, -1, -1) for p in rest], names, kinds)

        step = written(left.coalesce(workers).mapInArrow(again, schema) if workers > 1 else left.repartition(1).mapInArrow(again, schema))
        if last:
            done.append(step)
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def tokenizer_path() -> str:
    """The public byte-level vocabulary; a parameter of pack()."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row, packed (see pack): null and empty texts are one piece of their end alone; an empty table gives none."""
    return pack(docs, tokenizer_path())
