"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (1 to 3 bytes of its lower-cased UTF-8 words), damped by a logarithm,
weighted by inverse document frequency and normalised. Each language has several centroids, found by spherical
k-means over its training vectors. The language of the nearest centroid by cosine is the prediction; a text
farther from it than nearly all training texts of that language is marked as rejected.

Training takes a bounded sample: at most `per_language` rows of each language, chosen by a hash of the id, and at
most `most_rows` in all. Predictions use whole texts.

Defined cases: a null text, or one without any letter, gets `und` with score 0; null languages don't teach;
without any training row everything is `und`; languages with fewer rows than centroids get one centroid a row;
ties go to the language that sorts first; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, per_text

DIMENSIONS = 1 << 14
CENTROIDS = 4
PER_LANGUAGE = 600
MOST_ROWS = 6000
#: Share of a language's training texts that may lie beyond its rejection distance.
BEYOND = 0.001
UNKNOWN = "und"
#: ASCII bytes that aren't letters count as blanks; words are parted by one blank.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of 1 to 3 bytes of a whole text."""
    letters = text.lower().encode("utf-8", "surrogatepass").translate(BLANKED).split()
    x = np.frombuffer(b" " + b" ".join(letters) + b" ", np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(251) + x[1:]
    three = two[:-1] * np.uint32(257) + x[2:]
    out = np.bincount((two * np.uint32(2654435761)) >> np.uint32(18), minlength=DIMENSIONS)
    out = out + np.bincount((three * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(18), minlength=DIMENSIONS)
    out[:256] += np.bincount(x, minlength=256)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def centroids_of(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from far-apart rows, so the result depends on the rows alone."""
    mean = unit(x.mean(axis=0, keepdims=True))
    chosen = [int(np.argmin(x @ mean[0]))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = np.vstack([mean, x[chosen[: max(0, min(k, len(x)) - 1)]]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.vstack([unit(x[near == j].sum(axis=0, keepdims=True)) if (near == j).any() else c[j : j + 1] for j in range(len(c))])
    return c


def training_rows(docs: DataFrame, learn: Column, key: str, text: str, lang: str, per_language: int, most_rows: int) -> list:
    """At most most_rows rows of (language, hashed counts), at most per_language ids of each language and one row of each id;
    the same rows however the table is dealt."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, most_rows)).collect()}
    if not sizes:
        return []
    each = max(1, min(per_language, most_rows // len(sizes)))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    # somewhat more than `each` ids of every language by a threshold on a hash of the id, and of these the first
    limits = [F.when(F.col("lang") == name, F.lit(int((1 << 30) * min(1.0, 1.15 * each / n)) + 1)) for name, n in sizes.items()]
    near = rows.where(draw < F.coalesce(*limits, F.lit(0)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    chosen = cut(near.select("lang", "id", draw.alias("draw")).distinct().withColumn("first", first).where(F.col("first") <= each).select("lang", "id"))
    taken = near.join(F.broadcast(chosen), near["lang"].eqNullSafe(chosen["lang"]) & near["id"].eqNullSafe(chosen["id"])).select(near["lang"], near["id"], near["text"])
    counted = per_text(taken, ["lang", "id"], "text", "c binary", lambda: lambda texts: ((sparse(counts(t)),) for t in texts))
    return counted.groupBy("lang", "id").agg(F.min("c").alias("c")).select("lang", "c").collect()  # most_rows rows at most


def sparse(c: np.ndarray) -> bytes:
    at = np.flatnonzero(c)
    return np.concatenate([at, c[at]]).astype("<u4").tobytes()


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> dict:
    """The model: inverse document frequencies, centroids, their languages and rejection distances.

    learn: a Column over `id` that tells the rows that may teach."""
    rows = training_rows(docs, learn, key, text, lang, per_language, most_rows)
    found = sorted(((r["lang"], np.frombuffer(r["c"], "<u4").reshape(2, -1)) for r in rows), key=lambda x: (x[0], x[1].tobytes()))
    names = sorted({n for n, _ in found})
    df = np.zeros(DIMENSIONS)
    for _, (at, _) in found:
        df[at] += 1
    idf = np.log((len(found) + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    centroids, of, limits = [], [], []
    for name in names:
        x = np.zeros((sum(n == name for n, _ in found), DIMENSIONS), dtype=np.float32)
        for i, (at, c) in enumerate(v for n, v in found if n == name):
            x[i, at] = np.log1p(c)
        x = unit(x * idf)
        c = centroids_of(x, CENTROIDS)
        centroids.append(c)
        of += [names.index(name)] * len(c)
        limits.append(float(np.quantile(1 - (x @ c.T).max(axis=1), 1 - BEYOND)) * 1.1)
    return {"names": names, "of": np.array(of, dtype=np.int64), "idf": idf, "centroids": np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32), "limits": limits}


def predict(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to the kept columns."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x centroids: its size doesn't depend on the rows

    def make():
        m = send.value
        names, c = m["names"], m["centroids"]
        of = m["of"]

        def score(texts):
            for t in texts:
                if t is None or not len(names) or not LETTER.search(t):
                    yield UNKNOWN, 0.0, True
                    continue
                x = np.log1p(counts(t).astype(np.float32)) * m["idf"]
                n = float(np.linalg.norm(x))
                near = (c @ x) / n if n else np.zeros(len(c))
                best = np.full(len(names), -1.0)
                np.maximum.at(best, of, near)
                i = int(best.argmax())
                sharp = np.exp(30 * (best - best[i]))
                yield names[i], float(min(1.0, 1 / sharp.sum())), bool(1 - best[i] > m["limits"][i])

        return score

    return per_text(docs, keep, text, "lang_pred string, score double, rejected boolean", make)


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, with a model learned from the rows that `learn` tells."""
    model = fit(docs, learn, key, text, lang)
    return predict(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model, ["doc_id"])


def dump(model: dict) -> str:
    """The model as JSON, to keep it."""
    return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in model.items()})
