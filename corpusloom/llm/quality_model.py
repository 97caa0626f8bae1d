"""Quality classifier: a factorisation machine.

Features of a document are its hashed words, structure statistics of the text and its metadata (length).
The machine adds a bias, a weight a feature, and for every pair of features the product of two low-rank
vectors; the sum over all pairs takes linear time, since it is half the difference of the squared sum and the sum
of squares. A logistic function makes it a score.

Training takes at most `most_rows` labelled rows, chosen by a hash of the id. Scores use whole texts.

Defined cases: null and empty texts are scored like any other (as a text without words); null labels don't teach;
rows of `labels` that repeat an id all teach; without a training row every score is 0.5; repeated rows give
repeated results; other columns pass or are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, per_text, taught_rows

BUCKETS = 1 << 13
RANK = 6
MOST_ROWS = 6000
#: Structure statistics: each is a feature with a value, and interacts with the words.
STATISTICS = 16
MEMORY = 300_000


class Features:
    """Feature vectors of texts, for one task; remembers the buckets of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        b = self.known.get(word)
        if b is None:
            b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
            if len(self.known) < MEMORY and len(word) <= 40:
                self.known[word] = b
        return b

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: statistics first, then hashed words scaled to unit length."""
        text = text or ""
        words = text.split()
        n, size = len(words), len(text)
        c = Counter(words)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, dtype=np.int64)
        upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
        signs = kinds[[35, 36, 37, 38, 42, 60, 62, 124]].sum()
        marks = kinds[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
        lines = text.split("\n")
        pairs = sum(a == b for a, b in zip(words, words[1:]))
        top = max(c.values(), default=0)
        m, s = max(n, 1), max(len(raw), 1)
        stats = np.array([
            1.0, np.log1p(n) / 8, np.log1p(size) / 10, len(c) / m, pairs / m, top / m, upper / s * 4, lower / s, digits / s * 4, signs / s * 8, marks / s * 8,
            (kinds[33] + kinds[63]) / s * 8, min(size / m / 12, 4.0), 1 - len(set(lines)) / len(lines), min(len(lines) / m * 4, 4.0), (n < 10) * 1.0,
        ], dtype=np.float32)
        if not c:
            return np.arange(STATISTICS), stats
        at = np.fromiter(map(self.bucket, c), np.int64, len(c))
        v = np.log1p(np.fromiter(c.values(), np.float32, len(c)))
        x = np.bincount(at, weights=v, minlength=0)
        at = np.flatnonzero(x)
        x = x[at].astype(np.float32)
        return np.concatenate([np.arange(STATISTICS), at + STATISTICS]), np.concatenate([stats, x / np.linalg.norm(x)])


def margin(model: dict, at: np.ndarray, x: np.ndarray) -> float:
    v = model["v"][at] * x[:, None]
    total = v.sum(axis=0)
    return float(model["bias"] + model["w"][at] @ x + 0.5 * ((total * total).sum() - (v * v).sum()))


def sigmoid(z: float | np.ndarray):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.05, seed: int = 3) -> dict:
    """Adagrad on the logistic loss, in batches; rows: (label, indices, values)."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + STATISTICS
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, RANK)).astype(np.float32)
    bias, gb, gw, gv = 0.0, 1e-2, np.full(n, 1e-2, np.float32), np.full((n, RANK), 1e-2, np.float32)
    if not rows:
        return {"bias": 0.0, "w": w, "v": np.zeros_like(v)}
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, x = rows[i]
            f = v[at] * x[:, None]
            total = f.sum(axis=0)
            z = bias + w[at] @ x + 0.5 * ((total * total).sum() - (f * f).sum())
            g = sigmoid(float(z)) - y
            gb += g * g
            bias -= rate * g / gb**0.5
            d = g * x + 1e-5 * w[at]
            gw[at] += d * d
            w[at] -= rate * d / np.sqrt(gw[at])
            d = g * x[:, None] * (total - f) + 1e-5 * v[at]
            gv[at] += d * d
            v[at] -= rate * d / np.sqrt(gv[at])
    return {"bias": float(bias), "w": w, "v": v}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> dict:
    """learn: a Column over `id` that tells the rows that may teach. The sample is at most most_rows rows of labels, the same
    however the tables are dealt."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1) & F.col("id").isNotNull())
    taught = taught_rows(docs, known, ["y"], key, text, most_rows, 3)

    def make():
        features = Features()
        return lambda texts: ((at.astype("<i4").tobytes(), x.astype("<f4").tobytes()) for at, x in map(features.of, texts))

    rows = per_text(taught, ["id", "y"], "text", "i binary, x binary", make).collect()  # most_rows rows at most
    return train([(r["y"], np.frombuffer(r["i"], "<i4"), np.frombuffer(r["x"], "<f4")) for r in sorted(rows, key=lambda r: (r["id"], r["y"], r["i"]))])


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score to the kept columns; one narrow pass."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + STATISTICS) x (RANK + 1) numbers, whatever the input

    def make():
        features = Features()
        return lambda texts: ((float(sigmoid(margin(send.value, *features.of(t)))),) for t in texts)

    return per_text(docs, keep, text, f"`{out}` double", make)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    model = fit(docs, labels, learn, key, text)
    rows = score(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model, ["doc_id"])
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    model = fit(docs, labels, learn, key, text)
    mark = fresh(docs, "quality_score")
    return score(docs, model, docs.columns, text, mark).where(F.col(mark) >= 0.5).drop(mark)
