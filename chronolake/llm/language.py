"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent, with calibrated rejection."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, held_out, stratified_sample

BUCKETS, WIDTH = 2**15, 16
#: Labelled documents that a model is fitted on, at most (about); a documented bound, as fitting takes a fixed time.
SAMPLE = 2500
#: Words that a Python worker remembers; when they are more, it starts anew. Results do not depend on it.
REMEMBERED = 600_000
NONE = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def subwords(word: str) -> list[int]:
    """Buckets of a word's 1- to 4-grams with its ends marked, and of the word itself."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)} - {"<", ">"}
    grams.add(marked)
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in sorted(grams)]


def letters(text: str | None) -> list[str]:
    """Runs of letters of any script, lower-cased; nothing else of a text tells its language. Null: none."""
    return _LETTERS.findall(text.lower()) if text else []


@dataclass
class Model:
    """A language's score is linear in the average of subword embeddings, so embeddings times softmax weights are kept: BUCKETS x languages."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    sharpness: float
    threshold: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts; each distinct word is hashed once while it is remembered."""

    def __init__(self, model: Model):
        self.model, self.rows, self.number = model, np.zeros((1024, len(model.languages) + 1)), {}

    def learn(self, word: str) -> int:
        """The row of a new word: the sum of its subwords' scores, and their number."""
        n = self.number[word] = len(self.number)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = subwords(word)
        self.rows[n, :-1] = self.model.table[at].sum(0, dtype=np.float64)
        self.rows[n, -1] = len(at)
        return n

    def text(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; `und` and 0 where there is no letter."""
        found = letters(text)
        if not found or not self.model.languages:
            return NONE, 0.0
        if len(self.number) >= REMEMBERED:
            self.number.clear()
        get, learn = self.number.get, self.learn
        at = [n if (n := get(w)) is not None else learn(w) for w in found]
        total = self.rows[at].sum(0)
        logits = (total[:-1] / total[-1] + self.model.bias) * self.model.sharpness
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.model.languages[best], float(p[best] / p.sum())


def fit(texts: list[str], langs: list[str], seed: int = 0, epochs: int = 6, rate: float = 4.0, fragments: int = 6) -> Model:
    """Fits on fragments of 1 to 96 words from all over each text, so short and long texts are both met; every fifth text calibrates.

    Sharpness (a temperature) is chosen by likelihood on the calibration texts' fragments; the rejection threshold is what all but a
    thousandth of those whole texts that were judged rightly reach, and at most one half.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    k = len(names)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    number = {x: i for i, x in enumerate(names)}
    known: dict[str, list[int]] = {}

    def bag(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at: list[int] = []
        for w in found:
            if (s := known.get(w)) is None:
                s = known[w] = subwords(w)
            at += s
        ids, n = np.unique(np.asarray(at), return_counts=True)
        return ids, (n / n.sum()).astype(np.float32)

    train, check, whole = [], [], []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        found = letters(t)
        if not found:
            continue
        aside = i % 5 == 4
        for _ in range(fragments):
            n = int(np.exp(rng.uniform(0, np.log(96))))
            at = int(rng.integers(0, max(1, len(found) - n + 1)))
            (check if aside else train).append((*bag(found[at : at + n]), number[lang]))
        if aside:
            whole.append((t, number[lang]))
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    steps, done, size = max(1, epochs * len(train) // 32), 0, 32
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for lo in range(0, len(order), size):
            part = [train[j] for j in order[lo : lo + size]]
            lengths = np.array([len(p[0]) for p in part])
            ids, w = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            starts = np.cumsum(lengths) - lengths
            hidden = np.add.reduceat(table[ids] * w[:, None], starts, axis=0)
            z = hidden @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(part)), [p[2] for p in part]] -= 1
            step = rate * max(0.05, 1 - done / steps) / len(part)
            back = z @ out.T
            out -= step * (hidden.T @ z)
            bias -= step * z.sum(0)
            # a subword's share of a bag is small, so embeddings learn faster than the softmax does
            np.subtract.at(table, ids, (8 * step) * w[:, None] * np.repeat(back, lengths, axis=0))
            done += 1
    model = Model(names, (table @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if check:
        logits = np.array([(model.table[ids] * w[:, None]).sum(0) + model.bias for ids, w, _ in check])
        truth = np.array([c[2] for c in check])

        def loss(sharp: float) -> float:
            z = logits * sharp
            z = z - z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

        model.sharpness = min((2.0 ** (e / 4) for e in range(-12, 13)), key=loss)
        scorer = model.scorer()
        right = [s for t, y in whole for lang, s in [scorer.text(t)] if lang == names[y]]
        model.threshold = min(0.5, float(np.quantile(right, 0.001))) if right else 0.0
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE) -> Model:
    """A model from text and non-null lang of rows that are not held out; about `sample` of them, chosen by a hash of the key, languages
    alike. Rows without a letter teach nothing; an empty table gives a model without languages, which rejects everything."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(~held_out("k", folds) & F.col("l").isNotNull() & F.col("t").isNotNull())
    some, _ = stratified_sample(rows, "k", "l", sample, "language")
    rows = sorted(((r["k"] is None, str(r["k"]), r["t"], r["l"]) for r in some.toLocalIterator()))
    return fit([r[2] for r in rows], [r[3] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """All columns of docs with lang_pred, score and rejected added (columns of these names are replaced).

    Whole texts are judged, each word once per distinct word. Null texts and texts without a letter get `und`, 0 and are rejected; others
    are rejected if their calibrated score is below the model's threshold. One pass without a shuffle; repeated rows get equal answers;
    keys and other columns pass unchanged, null or not. drop_text: without the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: BUCKETS x languages floats

    def scorer() -> Callable[[list[str | None]], list[list]]:
        one = sent.value.scorer()

        def texts(some: list[str | None]) -> list[list]:
            got = [one.text(t) for t in some]
            return [[g[0] for g in got], [g[1] for g in got], [g[0] == NONE or g[1] < sent.value.threshold for g in got]]

        return texts

    return added(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())], scorer, drop_text)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), F.col("text").alias("_text")), train(docs), "_text", drop_text=True)
    return found


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, as they are. Null texts and those without a letter go, like those whose score is below the
    threshold; a null doc_id, lang or source is no reason to go; repeated rows stay or go together; an empty table stays empty."""
    return identify(docs, train(docs)).where("NOT rejected").select(*docs.columns)
