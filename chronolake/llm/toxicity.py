"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals aggregate to document scores and offsets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, held_out, stratified_sample

BUCKETS = 2**17
#: Labelled documents that the field is fitted on, at most (about).
SAMPLE = 4000
REMEMBERED = 250_000
#: Tokens whose chains are computed at once, and steps of a block of the scan.
CHUNK, STEPS = 400_000, 128
#: A feature marks toxic tokens if at least so many toxic documents hold it, this many times as often as clean ones do.
SEEN, LIFT = 4, 15.0
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_TOKEN = re.compile(r"\S+")
_WINDOW = 48


def features(token: str) -> list[str]:
    """The lower-cased word without what is no letter at its ends, its prefixes of 2 to 8 letters and suffixes of 2 to 4."""
    w = _EDGE.sub("", token).lower()
    if not w:
        return ["b"]
    return ["b", f"w{w}", *[f"p{w[:n]}" for n in range(2, min(len(w), 8) + 1)], *[f"s{w[-n:]}" for n in range(2, min(len(w), 4) + 1)]]


def buckets(token: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in features(token)]


def _scan(a: np.ndarray) -> np.ndarray:
    """r[t] = (a01 + a11 r[t-1]) / (a00 + a10 r[t-1]), r[-1] = 0, for a of shape (4, n): a00, a01, a10, a11.

    Exact, in blocks: the maps of a block of STEPS tokens are composed for all blocks at once, the blocks' ends are then chained, and the
    blocks are run again from their true starts. So a text of any length takes 2 x STEPS array operations and one pass over blocks.
    """
    n = a.shape[1]
    wide = -(-n // STEPS)
    full = np.zeros((4, wide * STEPS))
    full[0] = full[3] = 1.0
    full[:, :n] = a
    full = full.reshape(4, wide, STEPS)
    m = np.zeros((4, wide))
    m[0] = m[3] = 1.0
    for t in range(STEPS):
        x = full[:, :, t]
        m = np.stack([m[0] * x[0] + m[1] * x[2], m[0] * x[1] + m[1] * x[3], m[2] * x[0] + m[3] * x[2], m[2] * x[1] + m[3] * x[3]])
        m /= m.sum(0)
    starts, r = np.empty(wide), 0.0
    for i, (m00, m01, m10, m11) in enumerate(m.T.tolist()):
        starts[i] = r
        r = (m01 + m11 * r) / max(m00 + m10 * r, 1e-300)
    out, r = np.empty((wide, STEPS)), starts
    for t in range(STEPS):
        x = full[:, :, t]
        out[:, t] = r = (x[1] + x[3] * r) / np.maximum(x[0] + x[2] * r, 1e-300)
    return out.reshape(-1)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, start: float, move: np.ndarray) -> np.ndarray:
    """P(token is toxic) by forward-backward. emission: log-odds of each token, documents one after another; first: marks their starts.

    With two states only the ratio of a message's two parts matters. A document's first token ignores what came before, which makes the
    stream of many documents one chain.
    """
    if not len(emission):
        return emission
    e = np.exp(np.clip(emission, -30, 30))
    k = np.exp(move)
    s = np.exp(start)
    a = np.stack([np.where(first, 1.0, k[0, 0]), np.where(first, s, k[0, 1]), np.where(first, 1.0, k[1, 0]), np.where(first, s, k[1, 1])])
    forward = _scan(np.stack([a[0], a[1] * e, a[2], a[3] * e]))
    # backward: b[t] = (a10 + a11 e b) / (a00 + a01 e b) with a, e, b of t + 1; one at the end
    back = np.stack([a[0], a[2], a[1] * e, a[3] * e])[:, ::-1]
    back = np.concatenate([np.array([[1.0], [1.0], [0.0], [0.0]]), back[:, :-1]], axis=1)
    odds = forward * _scan(back)[::-1]
    return odds / (1 + odds)


@dataclass
class Model:
    weights: np.ndarray  # log-odds of a hashed feature
    start: float
    move: np.ndarray  # 2 x 2 log potentials, from row to column
    blend: np.ndarray  # intercept, and weights of the logit of the largest marginal and of the log of the expected toxic tokens


def _aggregate(p: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(1, logit of the largest marginal, log of the expected number of toxic tokens) for each document; no tokens: as with no evidence."""
    top, mass = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = lengths > 0
    if len(p):
        top[some] = np.maximum.reduceat(p, starts[some])
        mass[some] = np.add.reduceat(p, starts[some])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log(mass + 0.01)], axis=1)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.number, self.values = model, {}, np.zeros(1024)

    def learn(self, token: str) -> int:
        n = self.number[token] = len(self.number)
        if n == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[n] = self.model.weights[buckets(token)].sum()
        return n

    def emissions(self, text: str | None) -> np.ndarray:
        found = text.split() if text else []
        if len(self.number) >= REMEMBERED:
            self.number.clear()
        get, learn = self.number.get, self.learn
        at = [n if (n := get(w)) is not None else learn(w) for w in found]  # may replace self.values
        return self.values[at] if at else np.zeros(0)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores, and the spans (start, end in characters, largest marginal) of adjoining tokens that are toxic more likely than not."""
        scores, spans, at = [], [], 0
        while at < len(texts):
            parts, n = [], 0
            while at < len(texts) and (not parts or n < CHUNK):
                parts.append(self.emissions(texts[at]))
                n += len(parts[-1])
                at += 1
            lengths = np.array([len(x) for x in parts])
            starts = np.cumsum(lengths) - lengths
            first = np.zeros(n, bool)
            first[starts[lengths > 0]] = True
            p = marginals(np.concatenate(parts), first, self.model.start, self.model.move)
            x = _aggregate(p, starts, lengths)
            scores.append(1 / (1 + np.exp(-np.clip(x @ self.model.blend, -30, 30))))
            low = at - len(parts)
            for i in range(len(parts)):
                own = p[starts[i] : starts[i] + lengths[i]]
                spans.append(_spans(texts[low + i], own) if len(own) and own.max() >= 0.5 else [])
        return (np.concatenate(scores) if scores else np.zeros(0)), spans


def _spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i < len(p) and p[i] >= 0.5:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((m.start(), m.end(), float(p[i])))
            last = i
    return out


def labelled_tokens(texts: list[str], toxic: list[int]) -> list[tuple[list[str], np.ndarray]]:
    """Token labels from document labels: in toxic documents, tokens with a feature that marks them (SEEN, LIFT) are toxic."""
    bags = [t.split() for t in texts]
    kept: dict[str, list[str]] = {}

    def marks(w: str) -> list[str]:
        got = kept.get(w)
        if got is None:
            got = kept[w] = [f for f in features(w) if f[0] == "w" or f[0] == "p" and len(f) > 4]
        return got

    hit, miss = Counter(), Counter()
    for bag, y in zip(bags, toxic, strict=True):
        (hit if y else miss).update({f for w in set(bag) for f in marks(w)})
    bad, good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    strong = {f for f, n in hit.items() if n >= SEEN and n / bad >= LIFT * (miss[f] + 0.5) / good}
    return [(bag, np.array([bool(y) and any(f in strong for f in marks(w)) for w in bag], bool)) for bag, y in zip(bags, toxic, strict=True)]


def _forward_backward(e: np.ndarray, mask: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and pair marginals of windows (rows) by log-space messages; padding has mask False and follows the tokens."""
    n, t = e.shape
    unary = np.stack([np.zeros_like(e), e], axis=2)
    f = np.empty((n, t, 2))
    f[:, 0] = unary[:, 0] + [0.0, start]
    for i in range(1, t):
        f[:, i] = np.logaddexp(f[:, i - 1, :1] + move[0], f[:, i - 1, 1:] + move[1]) + unary[:, i]
    b = np.zeros((n, t, 2))
    for i in range(t - 2, -1, -1):
        x = unary[:, i + 1] + b[:, i + 1]
        y = np.stack([np.logaddexp(move[k, 0] + x[:, 0], move[k, 1] + x[:, 1]) for k in (0, 1)], axis=1)
        b[:, i] = np.where(mask[:, i + 1, None], y, 0.0)
    joint = f + b
    z = np.logaddexp(joint[..., 0], joint[..., 1])
    p = np.exp(joint[..., 1] - z)
    pairs = f[:, :-1, :, None] + move + (unary + b)[:, 1:, None, :]
    pairs = np.exp(pairs - z[:, :-1, None, None]) * mask[:, 1:, None, None]
    return p, pairs


def fit(texts: list[str], toxic: list[int], seed: int = 0, epochs: int = 6, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """Fits the field by Adagrad on windows of labelled tokens (every one with a toxic token, two clean windows of each document), then the blend on documents."""
    rng = np.random.default_rng(seed)
    windows: list[tuple[list[str], np.ndarray]] = []
    for bag, y in labelled_tokens(texts, toxic):
        cuts = range(0, len(bag), _WINDOW)
        chosen = {c for c in cuts if y[c : c + _WINDOW].any()} | {int(c) for c in rng.permutation(np.array(cuts))[:2]}
        windows += [(bag[c : c + _WINDOW], y[c : c + _WINDOW]) for c in sorted(chosen)]
    weights, square = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    start, move = 0.0, np.zeros((2, 2))
    known: dict[str, list[int]] = {}

    def hashed(w: str) -> list[int]:
        if (got := known.get(w)) is None:
            got = known[w] = buckets(w)
        return got

    batches = []
    order = rng.permutation(len(windows))
    for lo in range(0, len(order), 128):
        part = [windows[i] for i in order[lo : lo + 128]]
        t = max(len(w) for w, _ in part)
        mask, truth = np.zeros((len(part), t), bool), np.zeros((len(part), t))
        ids, of = [], []
        for i, (bag, y) in enumerate(part):
            mask[i, : len(bag)] = True
            truth[i, : len(bag)] = y
            for j, w in enumerate(bag):
                h = hashed(w)
                ids += h
                of += [i * t + j] * len(h)
        batches.append((mask, truth, np.array(ids), np.array(of)))
    known.clear()
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            mask, truth, ids, of = batches[k]
            e = np.bincount(of, weights[ids], mask.size).reshape(mask.shape)
            p, pairs = _forward_backward(e, mask, start, move)
            gap = (p - truth) * mask
            grad = np.bincount(ids, gap.reshape(-1)[of], BUCKETS) / len(mask) + penalty * weights
            square += grad**2
            weights -= rate * grad / np.sqrt(square)
            seen = np.stack([np.stack([(1 - truth[:, :-1]) * (1 - truth[:, 1:]), (1 - truth[:, :-1]) * truth[:, 1:]], 2), np.stack([truth[:, :-1] * (1 - truth[:, 1:]), truth[:, :-1] * truth[:, 1:]], 2)], 2) * mask[:, 1:, None, None]
            move -= 0.05 * ((pairs - seen).sum((0, 1)) / len(mask) + penalty * move)
            start -= 0.05 * float((p[:, 0] - truth[:, 0]).mean())
    model = Model(weights.astype(np.float32), start, move - move[0, 0], np.zeros(3))
    model.blend = _blend(model, texts, toxic)
    return model


def _blend(model: Model, texts: list[str], toxic: list[int]) -> np.ndarray:
    """Logistic regression, by Newton's steps with a small ridge, of document labels on what marginals aggregate to."""
    scorer, rows = Scorer(model), []
    for t in texts:
        e = scorer.emissions(t)
        first = np.zeros(len(e), bool)
        first[:1] = True
        rows.append(_aggregate(marginals(e, first, model.start, model.move), np.array([0]), np.array([len(e)]))[0])
    y, w = np.array(toxic, float), np.zeros(3)
    if not rows:
        return np.array([-3.0, 0.0, 0.0])
    x = np.array(rows)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w), -3, 3)
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, sample: int = SAMPLE) -> Model:
    """A model from documents with a 0/1 label whose key is not held out; about `sample` of them, chosen by a hash of the key, toxic ones
    up to half; scores are set back to the share of toxic ones among all labelled. Labels that disagree: toxic. No labels: a model that finds nothing."""
    few = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(~held_out("k", folds) & F.col("y").isin(0, 1) & F.col("k").isNotNull()).groupBy("k").agg(F.max("y").alias("y"))
    few, sizes = stratified_sample(few, "k", "y", sample, "toxicity")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(few), "k")  # about `sample` rows of key and label
    rows = sorted((str(r["k"]), r["t"], r["y"]) for r in rows.toLocalIterator())
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    bad = sum(r[2] for r in rows)
    if 0 < bad < len(rows) and sizes.get(0) and sizes.get(1):
        model.blend[0] += np.log(sizes[1] / sizes[0]) - np.log(bad / (len(rows) - bad))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """All columns of docs with score (0 to 1), predicted and spans added (columns of these names are replaced).

    Whole texts are tagged by exact forward-backward, of any length. Null and empty texts hold no evidence and get the score that this
    has; equal texts get equal scores. One pass without a shuffle; keys and other columns pass unchanged, null or not. drop_text: without
    the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: BUCKETS floats

    def scorer() -> Callable[[list[str | None]], list[list]]:
        one = Scorer(sent.value)

        def texts(some: list[str | None]) -> list[list]:
            scores, spans = one.texts(some)
            return [scores.tolist(), (scores >= 0.5).astype("int32").tolist(), [[{"start": a, "end": b, "marginal": p} for a, b, p in s] for s in spans]]

        return texts

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))
    return added(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", span)], scorer, drop_text)


def _trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), F.col("text").alias("_text")), _trained(spark, docs, sf_dir), "_text", drop_text=True)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, as they are. Null and empty texts hold no evidence and stay, unless most documents are toxic; a null
    doc_id is no reason to go; repeated rows stay or go together; an empty table stays empty, one without labels loses nothing."""
    return score(docs, _trained(spark, docs, sf_dir)).where("predicted = 0").select(*docs.columns)
