"""LM scoring: a causal self-attention model over subword ids, trained in numpy with kernels of onnxruntime; overlapping windows score each token once.

The model. A text is its lower-cased words, each the byte-level BPE ids of a space and the word, then one end. The next id's logits are
a direct path from the id before it (a table of corpus counts, all training documents) plus what two attention heads gather from up to
31 ids before it, which is trained: on a sample first, then by all executors on all training documents. The softmax covers the most frequent ids and one class for all others, whose members follow from
corpus counts, so that every text has a probability above 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kernels
from .common import bounded_sample, held_out, releasing, words, written
from .packing import tokenizer_path

#: Ids that the softmax tells apart, ids that embeddings tell apart, width, heads.
OUTPUTS, INPUTS, WIDTH, HEADS = 256, 2048, 16, 2
#: Each block of BLOCK ids is scored in a window of it and the block before.
BLOCK = 16
#: Documents that the attention's training starts on, at most (about), and ids of them. It goes on over all training documents.
SAMPLE, SAMPLE_IDS = 3000, 1_200_000
#: Words and id pairs that are sent to every worker, at most: the most frequent. Rarer words and pairs are looked up by joins.
SENT_WORDS, SENT_PAIRS = 1_000_000, 400_000
#: Distinct words that a worker counts or remembers before it hands them on or starts anew.
REMEMBERED = 600_000
#: Texts that are split at once.
SPLIT = 1024
#: Blocks whose windows are computed at once; few, so that their logits stay in the processor's cache.
BATCH = 128
#: The end, as an id and as a word's hash; also what stands before a text's first id. NONE stands for ids that are not told apart.
END, NONE = 2**17 - 1, 2**17 - 2
_END_HASH = -1
_SMOOTH, _BACK = 0.1, 2.0
#: Attention scores are bounded by it, far above what training gives.
_MOST = 60


def _hash(word: bytes) -> int:
    """Signed 64 bits; -1 is the end's."""
    h = xxhash.xxh3_64_intdigest(word)
    return (h - 2**64 if h >= 2**63 else h) if h != 2**64 - 1 else 0


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as places in the distinct ones; how many words each text has; and the distinct ones: as common.words splits
    them, but by Arrow, which looks each word up in less than a Python dict takes."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: pyarrow 23 lower-cases a cast slice, whose bytes begin inside their buffer, wrongly
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    code, many = parts.flatten().dictionary_encode(), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at, distinct = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), code.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in distinct:  # what is split off before a first blank and after a last one
        empty = at == distinct.index(b"")
        many -= np.bincount(np.repeat(np.arange(len(many)), many)[empty], minlength=len(many))
        at = at[~empty]
    return at, many, distinct


class _Numbers(dict):
    """Numbers of words, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and their counts."""
    distinct, at = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


class _Counter:
    """Counts of words and of pairs of ids that follow each other, inside words, from one word to the next, and at both ends of a text."""

    def __init__(self, encoder: bpe.ByteBPE):
        self.encoder, self.number, self.texts = encoder, _Numbers(), 0
        self.n, self.ends = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)  # by a word's number: count; first and last id
        self.inside: list[tuple[np.ndarray, np.ndarray]] = []  # of the words that came together: each pair of ids and its word's number
        self.across, self.waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [np.zeros(0, np.int64)]

    def add(self, texts: pa.Array) -> None:
        self.texts += len(texts)
        code, lengths, distinct = _coded(texts)
        w = np.array([self.number[x] if x else -1 for x in distinct], np.int64)[code]
        new = list(islice(reversed(self.number), len(self.number) - self.n.size))[::-1]
        if new:
            ids, opens = self.encoder.encode_words(new)
            ids = np.asarray(ids, np.int64)
            starts, stops = np.flatnonzero(opens), np.flatnonzero(np.append(opens[1:], True))
            at = np.flatnonzero(~np.asarray(opens, bool))
            self.inside.append((ids[at - 1] << 17 | ids[at], (np.cumsum(opens) - 1)[at] + self.n.size))
            self.ends = np.concatenate([self.ends, np.stack([ids[starts], ids[stops]])], axis=1)
            self.n = np.append(self.n, np.zeros(len(new), np.int64))
        self.n += np.bincount(w, minlength=self.n.size)
        at = np.cumsum(lengths + 1) - 1  # where a text ends
        first, last = np.full(len(w) + len(texts), END), np.full(len(w) + len(texts), END)
        word = np.ones(len(first), bool)
        word[at] = False
        first[word], last[word] = self.ends[0, w], self.ends[1, w]
        self.waiting.append(np.concatenate([[END], last[:-1]]) << 17 | first)
        if sum(map(len, self.waiting)) > 1_000_000:
            self.merge()

    def merge(self) -> None:
        pairs = np.concatenate([self.across[0], *self.waiting])
        self.across, self.waiting = _summed(pairs, np.concatenate([self.across[1], np.ones(len(pairs) - len(self.across[0]), np.int64)])), []

    def full(self) -> bool:
        return len(self.number) >= REMEMBERED or len(self.across[0]) >= 4 * REMEMBERED

    def told(self) -> pd.DataFrame:
        """(kind, key, n) of all that was added; nothing is left."""
        self.merge()
        pairs = [_summed(p, self.n[w]) for p, w in self.inside]
        pairs = _summed(np.concatenate([self.across[0], *[p[0] for p in pairs]]), np.concatenate([self.across[1], *[p[1] for p in pairs]]))
        key = np.concatenate([np.array([*map(_hash, self.number), _END_HASH], np.int64), pairs[0]])
        n = np.concatenate([self.n, [self.texts], pairs[1]])
        out = pd.DataFrame({"kind": (np.arange(len(key)) > len(self.number)).astype(np.int32), "key": key, "n": n})
        self.__init__(self.encoder)
        return out


def counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(kind, key, n) over all texts t of docs. kind 0: word (hash) and end; 1: pair of ids, before << 17 | id, END standing before a
    text's first id and after its last. Both are counted in each task before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(bpe.load(tokenizer))
        for batch in batches:
            for lo in range(0, len(batch), SPLIT):
                counter.add(batch.column("t").slice(lo, SPLIT))
                if counter.full():
                    yield pa.RecordBatch.from_pandas(counter.told(), preserve_index=False)
        yield pa.RecordBatch.from_pandas(counter.told(), preserve_index=False)

    return docs.mapInArrow(releasing(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")


def most_frequent(table: DataFrame, bound: int) -> tuple[DataFrame, bool]:
    """The rows of the largest n, not over `bound` of them, by one threshold from a histogram; and whether that is all."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    steps = sorted(((r["g"], r["k"]) for r in table.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect()), reverse=True)
    kept, least = 0, None
    for g, k in steps:
        if kept + k > bound:
            break
        kept, least = kept + k, g
    return (table.where(grade >= least) if least is not None else table.limit(0)), kept == sum(k for _, k in steps)


@dataclass
class Model:
    heads: np.ndarray  # ids of the softmax's symbols, by their number
    inputs: np.ndarray  # ids that have embeddings, likewise
    direct: np.ndarray  # (inputs + 1 for others, outputs + 1): log-probability given the id before
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    own: np.ndarray  # (inputs + 2, WIDTH): the last row is padding
    out: np.ndarray  # (WIDTH, outputs + 1)
    near: np.ndarray  # (HEADS, 2 * BLOCK): bias by distance
    pairs: np.ndarray  # sorted; counts of pairs of ids
    pair_n: np.ndarray
    rest: np.ndarray  # (2**17) log10 share of an id among those outside the softmax
    rest_pairs: np.ndarray  # (2**17) how often an id outside the softmax follows
    whole: bool = True  # whether pairs has all pairs whose second id is outside the softmax

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids as symbols and as inputs."""
        symbol, given = np.full(2**17, len(self.heads), np.int32), np.full(2**17, len(self.inputs), np.int32)
        symbol[self.heads], given[self.inputs] = np.arange(len(self.heads)), np.arange(len(self.inputs))
        return symbol, given

    def mask(self) -> np.ndarray:
        """(HEADS, BLOCK, 2 * BLOCK): bias by distance, minus infinity (nearly) for ids to come."""
        away = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
        return np.where(away >= 0, self.near[:, np.clip(away, 0, 2 * BLOCK - 1)], np.float32(-1e9)).astype(np.float32)


def blocks(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts (each with its end) in blocks: targets and the ids before them (both -1 where padded), and whether a block is a text's first."""
    lengths = np.array([len(x) for x in ids])
    many = -(-lengths // BLOCK)
    at = np.repeat((np.cumsum(many) - many) * BLOCK - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    flat = np.concatenate(ids)
    shifted = np.concatenate([[END], flat[:-1]])
    shifted[np.cumsum(lengths)[:-1]] = END
    target, before = np.full(many.sum() * BLOCK, -1, np.int64), np.full(many.sum() * BLOCK, -1, np.int64)
    target[at], before[at] = flat, shifted
    first = np.zeros(many.sum(), bool)
    first[np.cumsum(many) - many] = True
    return target.reshape(-1, BLOCK), before.reshape(-1, BLOCK), first


def _small(query: np.ndarray, key: np.ndarray) -> bool:
    """Whether no attention score can pass _MOST: scores are at most the product of a query's and a key's length."""
    long = lambda x: np.sqrt(np.einsum("nhd,nhd->nh", *[x.reshape(len(x), HEADS, -1)] * 2).max(0))
    return bool((long(query) * long(key) < _MOST).all())


class Scorer:
    """log10 probabilities of texts, given as ids."""

    def __init__(self, model: Model):
        self.m = model
        self.symbol, self.given = model.tables()
        self.weight = np.exp(model.mask())
        d, n = WIDTH // HEADS, len(model.own)
        value = np.ones((n, HEADS, d + 1), np.float32)  # the ones sum the weights
        value[:, :, :d] = model.value.reshape(n, HEADS, d)
        #: All that an input's embedding is needed for, in one row: query, key, value with a one for each head, own.
        self.rows = np.concatenate([model.query * np.float32(d**-0.5), model.key, value.reshape(n, -1), model.own], axis=1)
        self.small = _small(self.rows[:, :WIDTH], model.key)
        new = lambda *x: np.empty(x, np.float32)
        self.x, self.s, self.o = new((BATCH + 1) * BLOCK, self.rows.shape[1]), new(BATCH, HEADS, BLOCK, 2 * BLOCK), new(BATCH, HEADS, BLOCK, d + 1)
        self.a, self.h = new(BATCH * BLOCK, len(model.heads) + 1), new(BATCH * BLOCK, WIDTH)
        self.exp_s, self.exp_a, self.logits = kernels.Exp(self.s), kernels.Exp(self.a), kernels.AddProduct(self.h, np.ascontiguousarray(model.out), self.a)
        self.ones = np.ones(len(model.heads) + 1, np.float32)
        self.line = np.arange(BATCH * BLOCK) * (len(model.heads) + 1)

    def numbers(self, target: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pad = len(self.m.own) - 1
        given = np.where(before < 0, pad, self.given[before])
        previous = np.full_like(given, pad)
        previous[1:] = given[:-1]
        previous[first] = pad
        return np.where(target < 0, 0, self.symbol[target]), given, previous

    def hidden(self, given: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hidden states (kept until the next call) of consecutive blocks, given with the one before them: windows are views, masks multiply, and the product with the
        values also sums the weights. Attention scores are bounded, far above what training gives, in place of subtracting their maximum."""
        n, d = len(first), WIDTH // HEADS
        x = np.take(self.rows, given, axis=0, out=self.x[: len(given)], mode="clip")
        row, one = x.strides
        window = lambda at, wide: np.lib.stride_tricks.as_strided(x[:, at:], (n, HEADS, 2 * BLOCK, wide), (BLOCK * row, wide * one, row, one))
        q = x[BLOCK:, :WIDTH].reshape(n, BLOCK, HEADS, d).transpose(0, 2, 1, 3)
        s = np.matmul(q, window(WIDTH, d).transpose(0, 1, 3, 2), out=self.s[:n])
        if not self.small:
            np.minimum(s, np.float32(_MOST), out=s)
        self.exp_s(n)
        s *= self.weight
        if first.any():
            s[first, :, :, :BLOCK] = 0
        o = np.matmul(s, window(2 * WIDTH, d + 1), out=self.o[:n])
        o[..., :d] /= o[..., d:]
        out = self.h[: n * BLOCK]
        np.add(x[BLOCK:, -WIDTH:].reshape(n, BLOCK, HEADS, d), o[..., :d].transpose(0, 2, 1, 3), out=out.reshape(n, BLOCK, HEADS, d))
        return out

    def texts(self, ids: list[np.ndarray]) -> np.ndarray:
        return self.looked_up(ids)[0]

    def looked_up(self, ids: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Scores as far as the pairs sent tell; and for each text the pairs that were not, and what their counts are to be added to."""
        target, before, first = blocks(ids)
        symbol, given, _ = self.numbers(target, before, first)
        given = np.concatenate([np.full(BLOCK, len(self.m.own) - 1), given.reshape(-1)])
        flat_symbol = symbol.reshape(-1)
        picked, sums = np.empty(target.size, np.float32), np.empty(target.size, np.float32)
        for lo in range(0, len(target), BATCH):
            flat = slice(lo * BLOCK, (lo + BATCH) * BLOCK)
            own = given[lo * BLOCK : (lo + BATCH + 1) * BLOCK]
            n = len(self.hidden(own, first[lo : lo + BATCH]))
            logits = np.take(self.m.direct, own[BLOCK:], axis=0, out=self.a[:n], mode="clip")  # padding's row does not matter
            self.logits(n)
            picked[flat] = np.take(self.a, self.line[:n] + flat_symbol[flat])
            self.exp_a(n)  # logits are log-probabilities of counts and small corrections: they do not overflow
            sums[flat] = logits @ self.ones
        got = ((picked - np.log(sums)) / np.float32(np.log(10))).reshape(target.shape)
        got[target < 0] = 0
        score = got.astype(np.float64)
        rare = (symbol == len(self.m.heads)) & (target >= 0)
        score[rare] += self.others(before[rare], target[rare])
        score = np.add.reduceat(score.sum(1), np.flatnonzero(first))
        if self.m.whole:
            return score, [np.empty(0, np.int64)] * len(ids), [np.empty(0)] * len(ids)
        b, t = before[rare], target[rare]
        unsent = ~self.sent(b << 17 | t)[1]
        text = np.broadcast_to((np.cumsum(first) - 1)[:, None], rare.shape)[rare][unsent]
        cut = np.searchsorted(text, np.arange(1, len(ids)))
        return score, np.split((b << 17 | t)[unsent], cut), np.split(self.base(t)[unsent], cut)

    def sent(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs, 0 where not among those sent; and which are."""
        m = self.m
        if not len(m.pairs):
            return np.zeros(len(pair)), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(m.pairs, pair), len(m.pairs) - 1)
        found = m.pairs[at] == pair
        return np.where(found, m.pair_n[at], 0.0), found

    def base(self, target: np.ndarray) -> np.ndarray:
        """What a pair's count is added to: what its second id's own count lets expect."""
        return _BACK * 10.0 ** self.m.rest[target]

    def others(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(id | the id before, an id outside the softmax): counts of the pair, backed by the id's share."""
        n, _ = self.sent(before << 17 | target)
        return np.log10((n + self.base(target)) / (np.maximum(self.m.rest_pairs[before], 0) + _BACK))


def ranked(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the softmax and ids that have embeddings: the most frequent."""
    order = np.lexsort((np.arange(2**17), -count))
    order = order[: np.count_nonzero(count)].astype(np.int64)
    return order[:OUTPUTS], order[:INPUTS]


def started(pairs: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Model:
    """The model before training, of counts of pairs of ids that are all at hand."""
    before, after, n = pairs >> 17, pairs & (2**17 - 1), n.astype(np.float64)
    count = np.bincount(after, n, 2**17)
    order = np.argsort(pairs, kind="stable")
    return assembled(count, *ranked(count), (before, after, n), (before, after, n), (pairs[order], n[order]), True, rng)


def gathered(table: DataFrame, rng: np.random.Generator) -> Model:
    """The model before training. What it needs of the pairs is summed in Spark over the whole table, to a row an id, or a row of two ids
    that are told apart; of the pairs themselves, those that scoring looks up most often are brought here."""
    before, after = F.shiftright("key", 17), F.col("key").bitwiseAND(F.lit(2**17 - 1))
    pairs = table.where("kind = 1").select("key", before.alias("before"), after.alias("after"), "n")

    def summed(rows: DataFrame, *by: str) -> list[np.ndarray]:
        got = rows.groupBy(*by).agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values(list(by))
        return [*[got[c].to_numpy(np.int64) for c in by], got["n"].to_numpy(np.float64)]

    at, n = summed(pairs, "after")
    count = np.bincount(at, n, 2**17)
    heads, inputs = ranked(count)
    among = lambda c, ids: F.expr(f"{c} IN ({', '.join(map(str, [-1, *ids.tolist()]))})")
    told = pairs.select(F.when(among("before", inputs), F.col("before")).otherwise(NONE).alias("before"), F.when(among("after", heads), F.col("after")).otherwise(NONE).alias("after"), "n")
    rare = pairs.where(~among("after", heads))
    follows = summed(rare, "before")
    few, whole = most_frequent(rare.select("key", "n"), SENT_PAIRS)
    few = few.toArrow().to_pandas().sort_values("key")
    return assembled(count, heads, inputs, tuple(summed(told, "before", "after")), (follows[0], np.full(len(follows[0]), NONE), follows[1]), (few["key"].to_numpy(np.int64), few["n"].to_numpy(np.float64)), whole, rng)


def assembled(count: np.ndarray, heads: np.ndarray, inputs: np.ndarray, told: tuple, follow: tuple, sent: tuple, whole: bool, rng: np.random.Generator) -> Model:
    """The model of the ids' counts: told are counts of pairs (before, after, n), in which ids that are not told apart may stand as one,
    follow those whose second id may be outside the softmax, sent those to look up."""
    h, i = len(heads), len(inputs)
    symbol, given = np.full(2**17, h), np.full(2**17, i)
    symbol[heads], given[inputs] = np.arange(h), np.arange(i)
    grid = np.zeros((i + 1, h + 1))
    np.add.at(grid, (given[told[0]], symbol[told[1]]), told[2])
    share = np.bincount(symbol, count, h + 1) + _SMOOTH
    grid = (grid + 20 * share / share.sum()) / (grid.sum(1, keepdims=True) + 20)
    out = np.ones(2**17, bool)
    out[heads] = False
    rest = np.where(out, count + _SMOOTH, 0.0)
    with np.errstate(divide="ignore"):
        rest = np.log10(rest / rest.sum())
    follows = np.zeros(2**17)
    np.add.at(follows, follow[0][out[follow[1]]], follow[2][out[follow[1]]])
    draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return Model(heads, inputs, np.log(grid).astype(np.float32), draw(i + 2, WIDTH), draw(i + 2, WIDTH), draw(i + 2, WIDTH), draw(i + 2, WIDTH), np.zeros((WIDTH, h + 1), np.float32), np.zeros((HEADS, 2 * BLOCK), np.float32), *sent, rest, follows, whole)


def train(model: Model, ids: list[np.ndarray], seed: int = 0, epochs: int = 3, rate: float = 0.01, size: int = 256) -> Model:
    """Adam on the attention, its embeddings and their output weights; the direct path stays as counted."""
    if not ids:
        return model
    rng = np.random.default_rng(seed)
    scorer = Scorer(model)
    target, before, first = blocks(ids)
    symbol, given, previous = scorer.numbers(target, before, first)
    model.out[:] = rng.normal(0, 0.1, model.out.shape)
    steps = epochs * -(-len(target) // size)
    adam = Adam(model)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            adam.step(target[part], symbol[part], given[part], previous[part], rate * (1 - 0.9 * (adam.t + 1) / steps))
    return model


#: What training changes.
TRAINED = ["query", "key", "value", "own", "out", "near"]
#: Blocks to a step in the pass over all training documents, its pace, and blocks whose gradients are computed at once, as BATCH's logits.
STEP, PACE, CHUNK = 512, 0.002, 64


class Adam:
    """Steps of Adam on the attention, its embeddings and their output weights."""

    def __init__(self, model: Model):
        self.model, self.t = model, 0
        self.state = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in TRAINED}
        new, d, width = lambda *x: np.empty(x, np.float32), WIDTH // HEADS, len(model.heads) + 1
        self.x, self.y = new(CHUNK, BLOCK, 2 * WIDTH), new(CHUNK, 2 * BLOCK, 2 * WIDTH + HEADS)
        self.s, self.ds = new(CHUNK, HEADS, BLOCK, 2 * BLOCK), new(CHUNK, HEADS, BLOCK, 2 * BLOCK)
        self.o, self.do = new(CHUNK, HEADS, BLOCK, d + 1), new(CHUNK, HEADS, BLOCK, d + 1)
        self.p, self.hidden, self.scaled, self.out = new(CHUNK * BLOCK, width), new(CHUNK * BLOCK, WIDTH), new(CHUNK * BLOCK, WIDTH), new(WIDTH, width)
        self.exp_s, self.exp_p = kernels.Exp(self.s), kernels.Exp(self.p)
        self.logits, self.product = kernels.AddProduct(self.hidden, self.out, self.p), kernels.Product(self.scaled, self.p)
        self.ones, self.line = np.ones(width, np.float32), np.arange(CHUNK * BLOCK) * width

    def step(self, target: np.ndarray, symbol: np.ndarray, given: np.ndarray, previous: np.ndarray, rate: float) -> None:
        grads = self.grads(target, symbol, given, previous)
        self.t += 1
        pace = rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for name, x in grads.items():
            m, s = self.state[name]
            m += np.float32(0.1) * (x - m)
            s += np.float32(0.01) * (x * x - s)
            getattr(self.model, name)[...] -= np.float32(pace) * m / (np.sqrt(s) + np.float32(1e-8))

    def grads(self, target: np.ndarray, symbol: np.ndarray, given: np.ndarray, previous: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the blocks' mean cost an id. CHUNK blocks are computed at once; embeddings' rows are summed at the end, once.

        Divisions by sums, of the softmax and of the attention's weights, are made in the narrow factors of the products, not in the wide ones.
        """
        model, d, n = self.model, WIDTH // HEADS, len(target)
        weight, root = np.exp(model.mask()), np.float32(d**-0.5)
        value = np.ones((len(model.own), HEADS, d + 1), np.float32)  # the ones sum the weights
        value[:, :, :d] = model.value.reshape(-1, HEADS, d)
        query = np.concatenate([model.query * root, model.own], axis=1)
        keyed = np.concatenate([model.key, value.reshape(len(value), -1)], axis=1)
        small, by_symbol = _small(query[:, :WIDTH], model.key), np.ascontiguousarray(model.out.T)
        self.out[...] = model.out
        keys = np.concatenate([previous, given], axis=1)
        first = previous[:, 0] == len(model.own) - 1
        share = (target >= 0).reshape(-1) / np.float32(max(1, (target >= 0).sum()))
        of_given, of_keys = np.empty((n, BLOCK, 2 * WIDTH), np.float32), np.empty((n, 2 * BLOCK, 2 * WIDTH), np.float32)
        out, away_sum = np.zeros_like(model.out), np.zeros((HEADS, BLOCK, 2 * BLOCK), np.float32)
        split = lambda x: x.reshape(*x.shape[:2], HEADS, -1).transpose(0, 2, 1, 3)
        for lo in range(0, n, CHUNK):
            part = slice(lo, lo + CHUNK)
            g = given[part]
            m, flat = len(g), slice(lo * BLOCK, (lo + CHUNK) * BLOCK)
            x, y = np.take(query, g, axis=0, out=self.x[:m], mode="clip"), np.take(keyed, keys[part], axis=0, out=self.y[:m], mode="clip")
            q, k, v = split(x[:, :, :WIDTH]), split(y[:, :, :WIDTH]), split(y[:, :, WIDTH:])
            s = np.matmul(q, k.transpose(0, 1, 3, 2), out=self.s[:m])
            if not small:
                np.minimum(s, np.float32(_MOST), out=s)  # as in Scorer.hidden
            self.exp_s(m)
            s *= weight
            s[first[part], :, :, :BLOCK] = 0
            o = np.matmul(s, v, out=self.o[:m])
            sums, o = o[..., d:], o[..., :d]
            o /= sums
            hidden, scaled = self.hidden[: m * BLOCK], self.scaled[: m * BLOCK]
            np.add(x[:, :, WIDTH:].reshape(m, BLOCK, HEADS, d), o.transpose(0, 2, 1, 3), out=hidden.reshape(m, BLOCK, HEADS, d))
            p = np.take(model.direct, g.reshape(-1), axis=0, out=self.p[: m * BLOCK], mode="clip")  # padding's row does not matter
            self.logits(len(p))
            self.exp_p(len(p))  # as in Scorer.texts, they do not overflow
            total = p @ self.ones
            p.reshape(-1)[self.line[: len(p)] + symbol[part].reshape(-1)] -= total
            total = (share[flat] / total)[:, None]
            np.multiply(hidden, total, out=scaled)
            out += self.product(len(p))
            back = p @ by_symbol
            back *= total
            do = self.do[:m]  # the last column, beside the values' ones, takes the mean off
            np.divide(split(back.reshape(m, BLOCK, WIDTH)), sums, out=do[..., :d])
            np.negative(np.einsum("bhid,bhid->bhi", do[..., :d], o), out=do[..., d])
            ds = np.matmul(do, v.transpose(0, 1, 3, 2), out=self.ds[:m])
            ds *= s
            away_sum += ds.sum(0)
            np.matmul(ds, k, out=split(of_given[part, :, :WIDTH]))
            of_given[part, :, WIDTH:] = back.reshape(m, BLOCK, WIDTH)
            np.matmul(ds.transpose(0, 1, 3, 2), q, out=split(of_keys[part, :, :WIDTH]))
            np.matmul(s.transpose(0, 1, 3, 2), do[..., :d], out=split(of_keys[part, :, WIDTH:]))
        by_given, by_key = kernels.by_row(given, of_given, len(model.own)), kernels.by_row(keys, of_keys, len(model.own))
        away = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0, 2 * BLOCK - 1)
        near = np.stack([np.bincount(away.reshape(-1), x.reshape(-1), 2 * BLOCK) for x in away_sum]).astype(np.float32)
        return {"query": by_given[:, :WIDTH] * root, "key": by_key[:, :WIDTH], "value": by_key[:, WIDTH:], "own": by_given[:, WIDTH:], "out": out, "near": near}


class _Ids:
    """Ids of words. Words met are remembered by number, 0 being the end."""

    def __init__(self, encoder: bpe.ByteBPE):
        self.encoder, self.number = encoder, {}
        self.at, self.many, self.flat = np.zeros(1, np.int64), np.ones(1, np.int64), np.full(1, END, np.int64)  # by number: where ids begin, how many

    def full(self) -> bool:
        return len(self.number) >= REMEMBERED

    def numbered(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bytes]]:
        """The numbers of each text's words and of its end; and the words met for the first time, in the order of their numbers."""
        code, lengths, distinct = _coded(texts)
        new = [w for w in distinct if w and w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number) + 1, len(self.number) + 1 + len(new)), strict=True))
            ids, opens = self.encoder.encode_words(new)
            starts = np.flatnonzero(opens)
            self.at, self.many, self.flat = np.append(self.at, starts + len(self.flat)), np.append(self.many, np.diff(np.append(starts, len(ids)))), np.append(self.flat, ids)
        stops = np.cumsum(lengths + 1)
        w, word = np.zeros(len(code) + len(lengths), np.int64), np.ones(len(code) + len(lengths), bool)
        word[stops - 1] = False
        w[word] = np.array([self.number.get(x, -1) for x in distinct], np.int64)[code]
        return np.split(w, stops[:-1])[: len(lengths)], new

    def of(self, w: np.ndarray) -> np.ndarray:
        """Ids of the words numbered w, one after another."""
        length = self.many[w]
        return self.flat[np.repeat(self.at[w] - (np.cumsum(length) - length), length) + np.arange(length.sum())]


def refined(docs: DataFrame, model: Model, tokenizer: str) -> Model:
    """The model after a pass over all texts t of docs: each task goes on training its own copy on the documents it reads, and the
    copies' mean, weighted by their ids, is taken, first in about as many tasks as the root of their number."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    sizes = [getattr(model, k).size for k in TRAINED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the broadcast value may be another task's too
        model = Model(**{f.name: v.copy() if (v := getattr(sent.value, f.name)) is not None and f.name in TRAINED else v for f in fields(Model)})
        encoder, scorer, adam = bpe.load(tokenizer), Scorer(model), Adam(model)
        n, held, known = 0, [], _Ids(encoder)

        def learn(ids: list[np.ndarray]) -> int:
            target, before, first = blocks(ids)
            symbol, given, previous = scorer.numbers(target, before, first)
            order = np.random.default_rng(len(target)).permutation(len(target))
            for lo in range(0, len(order), STEP):
                part = order[lo : lo + STEP]
                # a small last step weighs as little as it holds
                adam.step(target[part], symbol[part], given[part], previous[part], PACE * len(part) / STEP)
            return sum(map(len, ids))

        for batch in batches:
            for lo in range(0, len(batch), SPLIT):
                if known.full():
                    known = _Ids(encoder)
                for w in known.numbered(batch.column("t").slice(lo, SPLIT))[0]:
                    held.append(known.of(w))
                    if len(held) == 128:
                        n, held = n + learn(held), []
        if held:
            n += learn(held)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [float(n)], "x": [(np.concatenate([getattr(model, k).reshape(-1) for k in TRAINED]).astype(np.float64) * n).tobytes()]})

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, x = 0.0, np.zeros(sum(sizes))
        for batch in batches:
            for k, raw in zip(batch["n"].tolist(), batch["x"].tolist(), strict=True):
                n, x = n + k, x + np.frombuffer(raw)
        yield pd.DataFrame({"n": [n], "x": [x.tobytes()]})

    copies = written(docs.mapInArrow(releasing(run), "n double, x binary"))
    few = copies.repartition(max(1, math.isqrt(copies.count()))).mapInPandas(mean, copies.schema)
    n, x = 0.0, np.zeros(sum(sizes))
    for r in few.toLocalIterator():
        n, x = n + r["n"], x + np.frombuffer(r["x"])
    if n:
        for k, part in zip(TRAINED, np.split(x / n, np.cumsum(sizes)[:-1]), strict=True):
            getattr(model, k)[...] = part.reshape(getattr(model, k).shape)
    return model


def fit(docs: DataFrame, table: DataFrame, tokenizer: str) -> Model:
    """The model of the texts t (keys k) of docs, whose counts are in table."""
    model = gathered(table, np.random.default_rng(0))
    encoder = bpe.load(tokenizer)
    texts = sorted((str(r["k"]), r["t"]) for r in bounded_sample(docs.where("t IS NOT NULL"), "k", SAMPLE, "lm").toLocalIterator())
    ids, total = [], 0
    for i in np.random.default_rng(1).permutation(len(texts)):
        if total >= SAMPLE_IDS:
            break
        ids.append(np.append(encoder.encode_words(words(texts[i][1]))[0], END))
        total += len(ids[-1])
    return refined(docs, train(model, ids), tokenizer)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, tokenizer: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    One pass counts the words of all rows that are not held out, and pairs of ids; a bounded sample of those rows starts the training of
    the attention, and a second pass over all of them goes on with it; a third pass
    scores whole texts, in windows, and looks up words. Counts of the most frequent words and pairs of ids (SENT_WORDS, SENT_PAIRS, size
    bounds) are broadcast; rarer ones are joined to their counts by shuffle, so base_score and score do not depend on the bounds. Null texts are empty: one token, the
    end. Null keys are never held out. Rows that repeat are scored each. An empty table gives no rows.
    """
    tokenizer = tokenizer or tokenizer_path()
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    learn = texts.where(~held_out("k", folds))
    table = written(counts(learn, tokenizer))
    vocabulary = table.where("kind = 0").select("key", "n")
    total, distinct = vocabulary.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(total or 0), int(distinct)
    top, whole = most_frequent(vocabulary, SENT_WORDS)
    top = top.toArrow().to_pandas().sort_values("key")
    model = fit(learn, table, tokenizer)
    known = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((model, known))  # bounded by SENT_WORDS, SENT_PAIRS and the model's fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (keys, n) = sent.value
        scorer, encoder = Scorer(model), bpe.load(tokenizer)
        known = _Ids(encoder)
        c, hashes = np.zeros(1), np.full(1, _END_HASH)  # by a word's number: its count (-1: not among those sent), and its hash

        def numbered(texts: pa.Array) -> list[np.ndarray]:
            nonlocal known, c, hashes
            if known.full():
                known, c, hashes = _Ids(encoder), c[:1], hashes[:1]
            numbers, new = known.numbered(texts)
            if new:
                h = np.array([_hash(w) for w in new], np.int64)
                if len(keys):
                    near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    count = np.where(keys[near] == h, n[near], 0.0 if whole else -1.0)
                else:
                    count = np.full(len(h), 0.0 if whole else -1.0)
                c, hashes = np.append(c, count), np.append(hashes, h)
            return numbers

        def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))

        def given(key: pa.Array, numbers: list[np.ndarray]) -> pa.RecordBatch:
            parts, out = [], []
            for w in numbers:
                parts.append(known.of(w))
                own = c[w[:-1]]
                seen = own[own >= 0]
                out.append((len(w), int((seen > 0).sum()), float(np.log10(seen + _SMOOTH).sum()), hashes[w[:-1][own < 0]]))
            n_tokens, n_known, sums, rare = zip(*out, strict=True)
            score, pairs, bases = scorer.looked_up(parts)
            columns = [key, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), lists(rare, pa.int64()), pa.array(score, pa.float64()), lists(pairs, pa.int64()), lists(bases, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["k", "n_tokens", "n_known", "sums", "rare", "score", "pairs", "bases"])

        for batch in batches:
            for lo in range(0, len(batch), SPLIT):
                key, numbers = batch.column(0).slice(lo, SPLIT), numbered(batch.column(1).slice(lo, SPLIT))
                for at in range(0, len(numbers), 256):
                    yield given(key.slice(at, 256), numbers[at : at + 256])

    kind = docs.schema[key].dataType.simpleString()
    scored = texts.mapInArrow(releasing(run), f"k {kind}, n_tokens long, n_known long, sums double, rare array<long>, score double, pairs array<long>, bases array<double>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    ends = float(vocabulary.where(f"key = {_END_HASH}").agg(F.sum("n")).first()[0] or 0)
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = rare.join(vocabulary, "key", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(_SMOOTH))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    out = scored.join(rare, "row", "left") if not whole else scored.withColumn("more", F.lit(0.0)).withColumn("also", F.lit(0))
    if not model.whole:
        pair = scored.select("row", F.explode(F.arrays_zip("pairs", "bases")).alias("p")).select("row", F.col("p.pairs").alias("key"), F.col("p.bases").alias("base"))
        pair = pair.groupBy("row", "key").agg(F.count("*").alias("times"), F.max("base").alias("base"))
        pair = pair.join(table.where("kind = 1").select("key", "n"), "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(1 + F.col("n") / F.col("base"))).alias("pairs_more"))
        out = out.join(pair, "row", "left").withColumn("score", F.col("score") + F.coalesce("pairs_more", F.lit(0.0)))
    scale = float(np.log10(total + _SMOOTH * (distinct + 1)))
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + _SMOOTH))) - F.col("n_tokens") * F.lit(scale)
    known = F.col("n_known") + F.coalesce("also", F.lit(0)) + F.lit(int(ends > 0))
    return out.select(F.col("k").alias(key), held_out("k", folds).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
