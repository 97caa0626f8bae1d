"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import language, mixing, ngram_join, packing, quality_model, quality_rules, sharding, substring_dedup, suffixes, tokens, topk

FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    words = ["the", "of", "Und", "der", "maison", "naïve", "x1", "<|endoftext|>", "😀", "՘z", "$$$", "don't"]
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(60)) for _ in range(12)]
    out = base + base[:3]
    for b in base[:6]:  # near copies, and passages in other surroundings
        w = b.split(" ")
        w[rng.randint(0, 59)] = "changed"
        out.append(" ".join(w))
        out.append("start " + b[40:140] + " end " + str(rng.random()))
    return [*out, None, "", "   ", "\n\n", "one", "two words", "a b c", "A B C", "be " * 3000, "line\nline\nline\n", "é" * 40, "z" * 70000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t), 7) for i, t in enumerate(texts())]
    rows += [rows[2], (None, "no id here but some words", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(0, 30)] + [(1, None, None), (None, 1, False)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


def test_packing_round_trip(spark, docs):
    library = Tokenizer.from_file(FILE)
    rows = packing.pack(docs, FILE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"]), []).append((r["start"], r["length"], bytes(r["ids"])))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in enumerate(texts()):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        times = 2 if i == 2 else 1
        got = b"".join(p for _, _, p in sorted(by_doc[i]))
        assert len(got) == times * len(want) and (times == 2 or got == want)
    padded = packing.sequences(packing.pack(docs, FILE)).select(F.length("ids").alias("n")).distinct().collect()
    assert [r["n"] for r in padded] == [4096]


def test_differencing_fills_windows():
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 1024, 200), np.full(200, 64)])
    at = packing.windows_of(sizes, 1024)
    load = np.bincount(at, weights=sizes)
    assert load.max() <= 1024 and 1 - load.sum() / (1024 * len(load)) < 0.03
    assert packing.windows_of(np.array([5]), 1024).tolist() == [0]


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(FILE)
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, FILE).collect()}
    for i, t in enumerate(texts()):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024), t
    other = tokens.counting(public_tokenizers.path("word_bpe_49k.json"))
    assert other("hello there") == len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("hello there", add_special_tokens=False).ids)


def test_whole_tokens_are_proved():
    v = tokens.byte_level(FILE)
    library = Tokenizer.from_file(FILE)
    some = random.Random(1).sample(sorted(v.whole), 500)
    assert all(library.encode(s, add_special_tokens=False).ids == [v.whole[s]] for s in some)


def shingle_set(t, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 100), (2, 50)])
def test_ngram_join(spark, docs, width, percent):
    rows = [(r["doc_id"], shingle_set(r["text"], width)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = sorted((str(d), len(s), least.get(root(i), None)) for i, (d, s) in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, width, percent).collect())
    assert got == want


def test_ngram_join_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(0, 119)] = f"c{rng.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t, 3) for _, t in rows]
    label = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()} == dict(enumerate(label))


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(100):
        x = bytes(rng.choice(b"ab\0c"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 120)))
        sa = suffixes.suffix_array(np.frombuffer(x, np.uint8), 56)
        assert sorted(sa.tolist()) == list(range(len(x)))
        assert [x[i : i + 56] for i in sa] == sorted(x[i : i + 56] for i in range(len(x)))


def test_substring_dedup(spark, docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    big = 1 << 62
    first = {}
    for d, b in rows:
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, big), big if d is None else d)
    want = []
    for d, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < (big if d is None else d):
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        want.append((str(d), len(b), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(str(r["doc_id"]), r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    left = substring_dedup.without_repeats(docs)
    assert left.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in left.where("n_chars is not null").collect())


def brute_spans(rows):
    first = {}
    for d, b in rows:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], d), d)
    out = {}
    for d, b in rows:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < d:
                gone[s + 1 : s + 51] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)))
        out[d] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


@pytest.mark.parametrize("frequent", [1, 60])
def test_frequent_anchors_are_cut(monkeypatch, frequent):
    """All steps in this process, over three blocks, with anchors frequent from two documents on."""
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(75))
    rows = [(i, f"{rng.random()} {line if i % 4 else line[:60] + 'x' + line[60:]} {rng.random()}" * rng.randint(1, 2)) for i in range(40)]
    n = 3
    blocks = [[r for r in rows if r[0] % n == k] for k in range(n)]
    tables = [pa.table({"d": [d for d, _ in b], "t": [t for _, t in b], "block": [k] * len(b)}) for k, b in enumerate(blocks)]
    key = lambda k: (pa.scalar(k),)
    pick = lambda t, c, k: t.filter(pc.equal(t[c], k))
    sent = pa.concat_tables([substring_dedup.anchors(n, 50)(key(k), t) for k, t in enumerate(tables)])
    reply = pa.concat_tables([substring_dedup.held_by_several(key(k), pick(sent, "bucket", k)) for k in range(n)])
    asked = pa.concat_tables([substring_dedup.contexts(n, 50)(key(k), t, pick(reply, "block", k)) for k, t in enumerate(tables)])
    answer = pa.concat_tables([substring_dedup.sorted_suffixes(50)(key(k), pick(asked, "bucket", k)) for k in range(n)])
    got = {}
    for k, t in enumerate(tables):
        out = substring_dedup.applied(["d"], None, None)(key(k), t, pick(answer, "block", k))
        got.update({d: [(x["start"], x["end"]) for x in s] for d, s in zip(out["d"].to_pylist(), out["spans"].to_pylist())})
    assert got == brute_spans([(d, t.encode()) for d, t in rows])


def test_top_k(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 0.2, (120, 20))
    m[7] = m[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(200, None), (201, [1.0, None]), (220, [float("nan")] * 20), (240, []), (260, [0.5] * 3), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, v in q:
        if i % 20 == 0:
            s = sorted((-int(v @ c), j) for j, c in q if j != i and len(c) == len(v))[:20]
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == sorted(want)


def test_sharding(spark, docs):
    rows = sharding.shard(docs, 7).collect()
    n = docs.count()
    assert len(rows) == n and sorted(r["slot"] * 7 + r["shard"] for r in rows) == list(range(n))
    text = dict(enumerate(texts()))
    for r in rows:
        if r["doc_id"] is not None:
            raw = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    again = {(r["doc_id"], r["row_number"]): r["shard"] for r in sharding.shard(docs.repartition(2), 7).collect()}
    assert again == {(r["doc_id"], r["row_number"]): r["shard"] for r in rows}


def test_quality_rules(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts()):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, t[:80]
        assert not (r["base_failed"] and r["kept"])


def test_language_and_quality_and_mixing_on_the_test_tables(spark):
    at = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    fold = lambda n: F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(n))
    held = lambda n, k: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == k
    found = language.identify(d, fold(4) != 2).join(d, "doc_id").where(held(4, 2))
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    found = quality_model.classify(d, lab, fold(3) != 1).join(lab, "doc_id").where(held(3, 1))
    assert found.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97
    kind = lab.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))
    names, share = ["clean", "low", "toxic"], {"clean": 0.9, "low": 0.08, "toxic": 0.02}
    rows = mixing.mix(d, kind, names, mixing.shares_of(share, names)).toPandas()
    assert (rows.rate >= 0).all() and len(rows) == 1000
    for n in names:
        assert abs((rows.rate * rows.tokens * rows[f"p_{n}"]).sum() / rows.tokens.sum() - share[n]) < 1e-4


def test_learners_without_rows_or_letters(spark, docs, labels):
    never = F.lit(False)
    assert {r["lang_pred"] for r in language.identify(docs, never).collect()} == {"und"}
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, F.lit(True)).collect()}
    assert all(got[i] == "und" for i, t in enumerate(texts()) if not t or not any(c.isalpha() for c in t)) and set(got.values()) <= {"en", "fr", "und"}
    assert {r["score"] for r in quality_model.classify(docs, labels, never).collect()} == {0.5}
    assert quality_model.accepted(docs, labels, never).columns == docs.columns
    none = labels.limit(0).select("doc_id", F.lit("a").alias("domain"))
    out = mixing.mixed(docs, none, ["a", "b"], mixing.factors_of({}, ["a", "b"]))
    assert out.columns == docs.columns and out.count() == docs.count()


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    yes = F.lit(True)
    assert packing.pack(none, FILE).count() == 0
    assert tokens.count_tokens(none, FILE).count() == 0
    assert ngram_join.join(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert language.identify(none, yes).count() == 0
    assert quality_model.classify(none, labels, yes).count() == 0
    assert mixing.mix(none, labels.select("doc_id", F.lit("a").alias("domain")), ["a"], mixing.factors_of({}, ["a"])).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0
