"""The pipeline's stages, each on what the one before kept, held against brute force on the smallest tables."""

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        out.append(docs.collect())
    return out


def five_words(t):
    w = t.lower().split()
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(results):
    raw, good, single, cleaned, mixed, packed = results
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in raw} and 0.5 * len(raw) < len(good) < len(raw)
    sets = [(r["doc_id"], five_words(r["text"])) for r in sorted(good, key=lambda r: r["doc_id"])]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(sets):
            for b, y in sets[:i]:
                if x and y and label[a] != label[b] and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {r["doc_id"] for r in single} == {d for d in label if label[d] == d}
    first = {}
    for r in single:
        b = r["text"].encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], r["doc_id"]), r["doc_id"])
    left = {r["doc_id"]: r["text"] for r in cleaned}
    for r in single:
        b = r["text"].encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < r["doc_id"]:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert left.get(r["doc_id"], "") == kept
    assert {r["doc_id"] for r in mixed} <= set(left) and len(mixed) > 0.8 * len(cleaned)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["length"] for r in packed if r["start"] == 0) > 0


def test_run_equals_the_stages(spark, results):
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(tuple(r[k] for k in keys) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r[k] for k in keys) for r in results[-1])
