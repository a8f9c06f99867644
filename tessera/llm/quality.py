"""Graded quality by ordinal cumulative-link regression on hashed text.

Grades: 0 a toxic text, 1 a poor one that is not toxic, 2 a good one. A text is the set of its hashed
features, scaled to one length for all texts, so that long texts have no larger scores.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_once, fields, spared
from tessera.llm.decontaminate import words_of

#: Buckets of hashed features; labelled rows used for the fit; documents a feature must stand in; length of a text's features; highest grade.
BUCKETS = 1 << 20
MOST_LABELLED = 10_000
LEAST_ROWS = 8
LENGTH = 10.0
TOP = 2
_LETTERS = bytes(c for c in range(256) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 or c in (32, 9, 10, 11, 12, 13))
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_RUN = re.compile(rb"[^0-9A-Za-z\x80-\xff\s]{2,}")


def shape_features(text: str, words: list[bytes]) -> list[bytes]:
    """Names of a text's form: shares of symbols, capitals and different words, word length and size, in steps."""
    raw = text.encode("utf-8", "surrogatepass")
    n, w = max(1, len(raw)), max(1, len(words))
    step = lambda x: min(20, int(x * 20))
    symbols = len(raw.translate(None, _LETTERS)) / n
    capitals = len(raw.translate(None, _UPPER)) / n
    parts = {"symbols": step(4 * symbols), "capitals": step(capitals), "different": step(len(set(words)) / w) if w >= 20 else -1, "twice": step(sum(map(bytes.__eq__, words, words[1:])) / w), "length": min(20, int(sum(map(len, words)) / w)), "words": len(words).bit_length()}
    return [f"\0{k}={v}".encode() for k, v in parts.items()] + [b"\0run=" + x[:2] for x in set(_RUN.findall(raw))]


class Buckets(dict):
    """Buckets of a word and of its first four, five and six bytes, remembered."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 250_000:
            self.clear()
        parts = [word] + [word[:k] + b"*" for k in (4, 5, 6) if len(word) > k]
        self[word] = at = tuple(zlib.crc32(x) % BUCKETS for x in parts)
        return at


def features(text: str | None, at: Buckets) -> list[int]:
    """Different buckets of a text's words and their beginnings, and of its form."""
    text = text or ""
    words = words_of(text)
    return list(set(chain.from_iterable(map(at.__getitem__, set(words))))) + [zlib.crc32(x) % BUCKETS for x in shape_features(text, words)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sets of features in slices, so that a step needs little more memory than the rows themselves."""

    def __init__(self, rows: list, place: np.ndarray, width: int):
        self.width, self.slices = width, []
        for k in range(0, len(rows), 500):
            part = rows[k : k + 500]
            cols = [c[c >= 0] for c in (place[np.asarray(r, np.int64)] for r in part)]
            self.slices.append((slice(k, k + len(cols)), np.concatenate(cols), np.array([len(c) for c in cols]), np.array([scale(len(r)) for r in part])))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([by * np.bincount(np.repeat(np.arange(len(size)), size), w[col], len(size)) for _, col, size, by in self.slices]) if self.slices else np.zeros(0)

    def back(self, slope: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for at, col, size, by in self.slices:
            out += np.bincount(col, np.repeat(slope[at] * by, size), self.width)
        return out


def scale(n: int) -> float:
    return LENGTH / max(n, 1) ** 0.5


def loss(rows: Rows, grades: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, l2: float) -> tuple[float, list]:
    """Negative log likelihood with its penalties, and its gradients by weights, first threshold and logarithms of the gaps."""
    top = len(gaps) + 1
    cuts = thresholds(first, gaps)
    ext = np.concatenate(([-np.inf], cuts, [np.inf]))
    s = rows.scores(w)
    hi, lo = np.where(grades < top, _sigmoid(ext[np.minimum(grades + 1, top)] - s), 1.0), np.where(grades > 0, _sigmoid(ext[grades] - s), 0.0)
    p = np.maximum(hi - lo, 1e-9)
    up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
    d_cut = np.array([down[grades == k + 1].sum() - up[grades == k].sum() for k in range(top)])
    d_gap = np.array([d_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)])
    value = -np.log(p).sum() + l2 / 2 * w @ w + 0.05 * (first @ first + gaps @ gaps)
    return value, [l2 * w + rows.back(1 - hi - lo), np.array([d_cut.sum()]) + 0.1 * first, d_gap + 0.1 * gaps]


def thresholds(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """A first one and positive gaps: they rise even where a grade has no rows."""
    return first[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


class CumulativeLink:
    """P(grade <= k) = sigmoid(t_k - w.x): one weight vector, rising thresholds t_1 < ... < t_K."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    @staticmethod
    def fit(rows: list, grades: np.ndarray, top: int = TOP, *, l2=1.0, steps=150, rate=0.1) -> CumulativeLink:
        """Adam on the whole sample."""
        seen = np.zeros(BUCKETS, np.int64)
        for r in rows:
            seen[r] += 1  # a row names a bucket once
        used = np.flatnonzero(seen >= LEAST_ROWS)
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        x = Rows(rows, place, len(used))
        params = [np.zeros(len(used)), np.array([-1.0]), np.zeros(top - 1)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n = max(1, len(rows))
        for t in range(1, steps + 1):
            _, grads = loss(x, grades, *params, l2)
            for i, g in enumerate(grads):
                g = g / n
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        out = np.zeros(BUCKETS, np.float32)
        out[used] = params[0]
        return CumulativeLink(out, thresholds(*params[1:]))

    def score(self, found: list[int]) -> float:
        return scale(len(found)) * float(self.weights[found].sum(dtype=np.float64))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a row a score."""
        return 1 - _sigmoid(self.cuts[None, :] - score[:, None])


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, text_col="text") -> DataFrame:
    """(doc_id, h, grade, text) of at most ``most`` different rated texts, chosen by the hash h of id and text.

    Labels that are not 0 or 1, or missing, are no ratings; a document with several ratings has a row
    for each; equal rows count once, however many they are.
    """
    rated = labels.filter("quality in (0, 1) and toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).cast("int").alias("grade")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    some = texts.select("doc_id", "h").distinct().join(rated, "doc_id").orderBy("h", "doc_id", "grade").limit(most)
    return texts.join(F.broadcast(some), ["doc_id", "h"])  # at most ``most`` rows of three numbers


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, text_col="text") -> CumulativeLink:
    """Features are made where the texts lie; the driver gets at most ``most`` lists of bucket numbers."""

    def run(batches):
        at = Buckets()
        for b in batches:
            yield b.assign(x=[np.asarray(features(t, at), np.int32).tobytes() for t in b["text"]])[["grade", "x", "doc_id", "h"]]

    def joined(batches):
        """All rows of a task as one of bytes."""
        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts)
            yield pd.DataFrame({"key": [b[["doc_id", "h", "grade"]].to_numpy(np.int64).tobytes()], "size": [b["x"].map(len).to_numpy(np.int64).tobytes()], "x": [b"".join(b["x"])]})

    found = few_at_once(labelled(docs, labels, most, text_col)).mapInPandas(run, "grade int, x binary, doc_id long, h long")
    found = found.groupBy("doc_id", "h", "grade").agg(F.first("x").alias("x")).coalesce(8).mapInPandas(joined, "key binary, size binary, x binary")
    keys, rows = [], []
    for r in found.toLocalIterator():  # one part of the sample at a time
        keys.append(np.frombuffer(r["key"], np.int64).reshape(-1, 3))
        rows += np.split(np.frombuffer(bytes(r["x"]), np.int32), np.cumsum(np.frombuffer(r["size"], np.int64) // 4)[:-1])
    keys = np.concatenate(keys) if keys else np.zeros((0, 3), np.int64)
    order = np.lexsort(keys.T[::-1])
    return CumulativeLink.fit([rows[i] for i in order], keys[order, 2])


ADDED = "score double, expected_grade double, p_ge_1 double, p_ge_2 double, accepted boolean"


def score(docs: DataFrame, model: CumulativeLink, *, text_col="text", keep=("doc_id",), least=0.5) -> DataFrame:
    """Adds score, expected_grade, p_ge_1, p_ge_2 and accepted (p_ge_2 >= ``least``).

    A null text is an empty one; the whole text counts; equal texts have equal scores; a kept column
    with the name of an added one gives way to it. A model of no ratings gives all texts the same score.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def run(batches):
        model, at = CumulativeLink(*sent.value), Buckets()
        for b in batches:
            s = np.array([model.score(features(t, at)) for t in b.pop("text\0")])
            tails = model.tails(s) if len(s) else np.zeros((0, TOP))
            b["score"], b["expected_grade"], b["p_ge_1"], b["p_ge_2"] = s, tails.sum(axis=1), tails[:, 0], tails[:, 1]
            b["accepted"] = b["p_ge_2"] >= least
            yield b

    keep = spared(keep, ADDED)
    return few_at_once(docs.select(*keep, F.col(text_col).alias("text\0"))).mapInPandas(run, fields(docs.select(*keep), ADDED))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
