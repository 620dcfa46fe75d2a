"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the letters of words, one of toxic and one of ordinary labelled texts, with contexts of up to three
letters.  Both end in the same backoff, the continuation counts of all labelled text, so that an expression which is
rare in both cannot speak for either.  Stretches of text are compared by their log-likelihood ratio per letter; the
strongest stretch and the whole text, each normalised by its length, enter a calibrated score.

Text is lower-cased and every run of non-letters is one mark.  Defined results: null text and text without a letter get the score of the share of toxic
rows in training; with one class or none among the labels every text gets the share seen (0 without labels); null labels
teach nothing; a document labelled several times counts each time; repeated rows are scored each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heightfield.llm import common as C

# Bound of the training sample: labelled rows per class for the models, and per class for the calibration.
ROWS, CALIBRATION = 3000, 1500
# Letters told apart (others share one symbol), the order of the models, and the length of a stretch.
LETTERS, ORDER, STRETCH = 46, 4, 12
SIZE = LETTERS + 2  # mark, letters, any other letter


class Reader:
    """Texts as symbols: 0 the mark, one for each letter of the alphabet, the last for any other letter."""

    def __init__(self, letters: np.ndarray):
        letter, lower = C.letter_codes()
        self.codes = np.zeros(len(letter), np.uint8)
        self.codes[letter] = SIZE - 1
        for k, c in enumerate(letters.tolist()):
            self.codes[letter & (lower == c)] = k + 1

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, with a mark before every word of each text, and the offsets of the texts."""
        points, off = C.code_points(*C.text_of(batch))
        s = self.codes[points]
        s = np.insert(s, off, 0)  # a mark before each text
        off = off + np.arange(len(off))
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[off[:-1]] = True
        before = np.concatenate([[0], np.cumsum(keep)])
        return s[keep][:before[off[-1]]], before[off]


def grams(s: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Code of the symbols that end at each place (marks stand before the beginning of a text)."""
    code, first = s.astype(np.int64), np.repeat(off[:-1], np.diff(off))
    for k in range(1, order):
        back = np.zeros(len(s), np.int64)
        back[k:] = s[:-k]
        back[np.arange(len(s)) - first < k] = 0
        code += back * SIZE**k
    return code


def _continuations(n: np.ndarray) -> list[np.ndarray]:
    """Counts of orders ORDER to 1, the lower ones as numbers of different left neighbours; axis 0 is the oldest symbol."""
    out = [n.astype(np.float64).reshape((SIZE,) * ORDER)]
    for _ in range(ORDER - 1):
        out.append((out[-1] > 0).sum(axis=0).astype(np.float64))
    return out


def _discount(n: np.ndarray) -> float:
    one, two = float((n == 1).sum()), float((n == 2).sum())
    return one / (one + 2 * two) if one and two else 0.75


def kneser_ney(counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Probabilities of the last symbol of every gram: interpolated over all orders, below order 1 the shared distribution."""
    p = shared
    for n in reversed(_continuations(counts)):
        d = _discount(n)
        total = n.sum(axis=-1, keepdims=True)
        kinds = (n > 0).sum(axis=-1, keepdims=True)
        own = np.maximum(n - d, 0) / np.maximum(total, 1)
        p = np.where(total > 0, own + d * kinds / np.maximum(total, 1) * p, p)
    return p


class Model:
    """Log-likelihood ratio of every gram and the calibration of the score."""

    def __init__(self, letters: np.ndarray, codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        self.letters = letters
        dense = np.zeros((2, SIZE**ORDER), np.float32)
        dense[0, codes], dense[1, codes] = toxic, ordinary
        lowest = _continuations(dense.sum(axis=0))[-1] + 0.5
        shared = lowest / lowest.sum()
        self.ratio = (np.log(kneser_ney(dense[0], shared)) - np.log(kneser_ney(dense[1], shared))).astype(np.float32).ravel()
        self.reader = Reader(letters)

    def evidence(self, batch: pa.RecordBatch) -> np.ndarray:
        """Per text: letters and marks, ratio per symbol of the whole text and of its strongest stretch."""
        s, off = self.reader(batch)
        value = self.ratio[grams(s, off)].astype(np.float64)
        n = np.diff(off) - 1  # the mark before a text is given
        value[off[:-1]] = 0.0
        run = np.concatenate([[0.0], np.cumsum(value)])
        whole = (run[off[1:]] - run[off[:-1]]) / np.maximum(n, 1)
        place = np.arange(len(value))
        first = np.repeat(off[:-1], np.diff(off))
        lo = np.maximum(place + 1 - STRETCH, first)
        stretch = (run[place + 1] - run[lo]) / STRETCH
        best = np.maximum.reduceat(stretch, off[:-1]) if len(n) else np.zeros(0)
        return np.stack([n, whole, best], axis=1)


def _held(docs: DataFrame, labels: DataFrame, part: int) -> DataFrame:
    """Bounded labelled rows of one part: (toxic, text), drawn by hash per class."""
    h = F.xxhash64("doc_id", F.lit(part))
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    mine = known.filter((F.pmod(F.xxhash64(F.col("doc_id")), F.lit(3)) == 0) == F.lit(bool(part)))
    order = Window.partitionBy("toxic").orderBy(h, "doc_id")
    drawn = mine.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= (CALIBRATION if part else ROWS)).select("doc_id", "toxic")
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")  # bounded by ROWS per class


class Toxicity:
    """What a task needs to score texts."""

    def __init__(self, letters, codes, toxic, ordinary, weights, share):
        self.parts = (letters, codes, toxic, ordinary)
        self.weights, self.share = weights, share
        self.key = hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in self.parts)).hexdigest()

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.weights is None:
            return np.full(batch.num_rows, self.share)
        n, whole, best = _model(self.key, self.parts).evidence(batch).T
        p = 1 / (1 + np.exp(-np.clip(_columns(n, whole, best) @ self.weights, -30, 30)))
        return np.where(n > 0, p, self.share)


def _columns(n, whole, best) -> np.ndarray:
    return np.stack([np.ones(len(n)), whole, best, np.log1p(n)], axis=1)


_MODELS: dict[str, Model] = {}


def _model(key: str, parts) -> Model:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*parts)
    return _MODELS[key]


def learn(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Models from one part of the labelled rows, calibration on the other; ``labels`` holds only rows that may teach."""
    share = labels.filter(F.col("toxic").isin(0, 1)).agg(F.avg("toxic"), F.min("toxic"), F.max("toxic")).first()
    none = np.zeros(0, np.int64)
    if share[0] is None or share[1] == share[2]:
        return Toxicity(none, none, none, none, None, float(share[0] or 0.0))
    rows = C.stored(_held(docs, labels, 0), "labelled")
    C.bounded(docs.sparkSession)

    def letters_of(batches):
        letter, lower = C.letter_codes()
        for block in C.blocks(batches):
            points = C.code_points(*C.text_of(block))[0]
            c, n = np.unique(lower[points[letter[points]]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n)], names=["c", "n"])

    often = rows.select("text").mapInArrow(letters_of, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c")
    letters = np.array(sorted(r["c"] for r in often.limit(LETTERS).collect()), np.uint32)

    def counted(batches):
        reader = Reader(letters)
        for block in C.blocks(batches):
            s, off = reader(block)
            code = grams(s, off)
            code = code * 2 + np.repeat(block.column(1).to_numpy().astype(np.int64), np.diff(off))
            code = np.delete(code, off[:-1])
            names, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names // 2), pa.array(names % 2), pa.array(n)], names=["gram", "toxic", "n"])

    sums = rows.select("text", "toxic").mapInArrow(counted, "gram bigint, toxic bigint, n bigint").groupBy("gram").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))
    got = sums.orderBy("gram").toArrow()  # at most SIZE ** ORDER grams, of bounded rows
    codes, toxic, ordinary = (got.column(c).to_numpy() for c in ("gram", "t", "o"))
    parts = (letters, codes, toxic.astype(np.int32), ordinary.astype(np.int32))
    key = hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in parts)).hexdigest()

    def weigh(batches):
        for block in C.blocks(batches):
            n, whole, best = _model(key, parts).evidence(block).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n, whole, best, block.column(1).to_numpy().astype(float))], names=["n", "whole", "best", "toxic"])

    def weighed(held: DataFrame):
        back = held.select("text", "toxic").mapInArrow(weigh, "n double, whole double, best double, toxic double").toArrow()
        return [back.column(c).to_numpy() for c in ("n", "whole", "best", "toxic")]

    n, whole, best, y = weighed(_held(docs, labels, 1))
    if len(np.unique(y)) < 2:  # too few labels to set some apart
        n, whole, best, y = weighed(rows)
    if len(np.unique(y)) < 2:
        return Toxicity(none, none, none, none, None, float(share[0]))
    return Toxicity(*parts, _calibrate(_columns(n, whole, best), y, float(share[0])), float(share[0]))


def _calibrate(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; classes weigh as in the labelled rows at large."""
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.01 * w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), grad)
    return w


def scored(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """``keep`` plus score, the chance that a text is toxic."""
    return C.extend(docs, lambda block: [pa.array(model.score(block))], "score double", keep)
