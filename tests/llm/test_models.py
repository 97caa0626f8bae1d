"""The learned operators and the divergence rules, restated in plain Python; equal models however tables are dealt; odd rows and columns."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, language, mixing, ngram_join, quality_model, quality_rules, substring_dedup, topk
from corpusloom.llm.queries import DOMAINS, domains_of, fold, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(9001, None, "en"), (9002, "", None), (9003, " \n\t ", "en"), (9004, "12 34 $$", "de"), (9005, "Ünïcode Straße ЖЖ", "de"), (9006, "a" * 50000, "en"), (9007, "word " * 20000, "fr")]
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    return rows.union(more).union(rows.where("doc_id < 3")).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels").cache()


# language


def grams(text):
    """Weights of hashed n-grams of one to three bytes, one by one."""
    words = "".join(c if ord(c) >= 128 or c.isascii() and c.isalpha() else " " for c in text.lower()).split(" ")
    raw = (" " + " ".join(w for w in words if w) + " ").encode()
    out = {}

    def add(k):
        out[k] = out.get(k, 0) + 1

    for i in range(len(raw)):
        add(raw[i])
        if i + 1 < len(raw):
            two = raw[i] * 251 + raw[i + 1]
            add((two * 2654435761 % 2**32) >> 18)
        if i + 2 < len(raw):
            three = (two * 257 + raw[i + 2]) % 2**32
            add(((three * 2246822519 + 97) % 2**32) >> 18)
    return out


def test_language_is_the_nearest_centroid(spark, docs):
    model = language.fit(docs, fold("id", 4) != 2)
    assert max(np.bincount(model["of"])) > 1  # several centroids a language
    got = {(r["doc_id"], r["text"]): r for r in language.predict(docs, model, ["doc_id", "text"]).collect()}
    for (_, text), r in got.items():
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        x = {k: math.log1p(n) * float(model["idf"][k]) for k, n in grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        near = {}
        for c, of in zip(model["centroids"], model["of"]):
            name = model["names"][of]
            near[name] = max(near.get(name, -1.0), sum(v * float(c[k]) for k, v in x.items()) / norm)
        best = max(near.values())
        assert near[r["lang_pred"]] >= best - 1e-5
        assert r["score"] == pytest.approx(1 / sum(math.exp(30 * (v - best)) for v in near.values()), abs=1e-3)
        far = 1 - best - model["limits"][model["names"].index(r["lang_pred"])]
        assert abs(far) < 1e-5 or r["rejected"] == (far > 0)


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = spark.createDataFrame([(i, "the same words", lang) for i, lang in enumerate(["bb", "aa", "bb", "aa"])], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(rows, F.lit(True)).collect()} == {"aa"}


# mixing


def marks_of(text):
    text = text or ""
    words = WORD.findall(text.lower())
    few = re.sub("[a-z ]+", "", text)
    m = max(len(text), 1)
    share = lambda kept, by: math.floor(min(sum(c in kept for c in few) / m * by, 5))
    out = [f" symbols {share(quality_rules.SYMBOLS, 25)}", f" capitals {share('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 10)}", f" bangs {share('!?', 25)}"]
    return words, set(words) | {*out, f" variety {math.floor(len(set(words)) / max(len(words), 1) * 6)}", f" length {math.floor(min(math.log2(len(words) + 1), 9))}"}


def test_posteriors_are_the_softmax_of_the_weights(spark, docs, labels):
    model = mixing.fit(docs, domains_of(labels), DOMAINS)
    assert len(model["words"]) > 20
    found = mixing.with_posteriors(docs.select("doc_id", "text"), model, "text", "p", "t").collect()
    for r in found:
        words, seen = marks_of(r["text"])
        logs = [b + sum(model["words"][w][i] for w in seen if w in model["words"]) for i, b in enumerate(model["base"])]
        top = max(logs)
        total = sum(math.exp(x - top) for x in logs)
        assert r["t"] == len(words)
        assert r["p"] == pytest.approx([math.exp(x - top) / total for x in logs], abs=1e-9)


def test_rates_meet_targets_and_are_the_nearest_to_one(spark):
    """What the optimum must satisfy: the targets hold, no rate is negative, and no other rates that hold them are nearer to 1."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([2, 0.6, 0.3], 300)
    t = rng.integers(1, 500, 300).astype(float)
    target = t @ p * np.array([1.0, 0.5, 0.05])
    rows = spark.createDataFrame([(float(x), y.tolist()) for x, y in zip(t, p)], "t double, p array<double>")
    steps = mixing.solve(rows, "p", "t", 3, lambda _: target)
    got = np.array([r["r"] for r in rows.coalesce(1).select("t", "p", mixing.rate("p", steps).alias("r")).orderBy("t", "p").collect()])
    order = sorted(range(300), key=lambda i: (t[i], p[i].tolist()))
    t, p = t[order], p[order]
    assert (got >= 0).all() and (got == 0).any()
    assert np.abs((got * t) @ p - target).max() <= 2e-6 * t.sum()
    far = t @ (got - 1) ** 2
    free = got > 1e-6
    for _ in range(50):  # other rates with the same tokens of each domain
        way = np.where(free, rng.normal(size=300), 0.0)
        a = (t[:, None] * p)[free]
        way[free] -= a @ np.linalg.lstsq(a.T @ a, a.T @ way[free], rcond=None)[0]
        way *= 0.5 * got[free].min() / np.abs(way).max()
        for sign in (1, -1):
            assert t @ (got + sign * way - 1) ** 2 >= far - 1e-9 * t.sum()


# the factorisation machine


def test_margin_is_the_sum_over_all_pairs(spark, docs, labels):
    model = quality_model.fit(docs, labels, fold("id", 3) != 1)
    features = quality_model.Features()
    got = {}
    for r in quality_model.classify(docs, labels, fold("id", 3) != 1).collect():
        got.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    for r in docs.where("doc_id % 9 = 0 or doc_id > 9000").collect():
        at, x = features.of(r["text"])
        v = model["v"][at].astype(float) * x[:, None]
        pairs = sum(float(v[i] @ v[i + 1 :].sum(axis=0)) for i in range(len(at)))  # each pair once
        z = model["bias"] + float(model["w"][at].astype(float) @ x) + pairs
        score = 1 / (1 + math.exp(-max(-40, min(40, z))))
        for s, predicted in got[r["doc_id"]]:
            assert s == pytest.approx(score, abs=1e-4) and predicted == (s >= 0.5)


# divergence rules


def distance(p, q):
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2, 0.0))


def test_distances_and_verdicts(spark, docs):
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]

    def histograms(text, lang):
        w = WORD.findall(text)
        chars = [sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), len(text) - sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text)]
        ascii_marks = sum(33 <= ord(c) <= 126 and not c.isalnum() for c in text)
        chars += [ascii_marks - chars[3], len(text) - chars[0] - chars[1] - chars[2] - ascii_marks]
        own = quality_rules.COMMON_WORDS.get(lang)
        listed = [w.count(x) for x in own] if own else [sum(x in quality_rules.ALL_WORDS for x in w)]
        return w, chars, [*listed, len(w) - sum(listed)]

    means, anys = {}, {}
    for _, text, lang in rows:
        w, *both = histograms(text, lang)
        if w:
            for kind, h in zip("cw", both):
                share = np.array(h) / sum(h)
                means.setdefault((kind, lang), []).append(share)
                anys.setdefault((kind, len(h)), []).append(share)
    got = {}
    for r in quality_rules.judge(docs).collect():
        got.setdefault(r["doc_id"], r)
    for doc, text, lang in rows:
        w, chars, common = histograms(text, lang)
        ref = lambda kind, h: np.mean(means[kind, lang] if lang is not None and (kind, lang) in means else anys[kind, len(h)], axis=0)
        r = got[doc]
        c = distance(np.array(chars) / sum(chars), ref("c", chars)) if len(text) >= quality_rules.MIN_CHARS else None
        d = distance(np.array(common) / sum(common), ref("w", common)) if len(w) >= quality_rules.MIN_WORDS else None
        assert (r["char_distance"] is None) == (c is None) and (r["word_distance"] is None) == (d is None)
        assert c is None or r["char_distance"] == pytest.approx(c, abs=1e-6)
        assert d is None or r["word_distance"] == pytest.approx(d, abs=1e-6)
        limit = quality_rules.MAX_WORD_DISTANCE
        if d is not None and (rest := ref("w", common)[-1]) <= 1 - quality_rules.LEAST_COMMON:
            none = distance([0.0] * (len(common) - 1) + [1.0], [(1 - rest) / (len(common) - 1)] * (len(common) - 1) + [rest])
            limit = min(limit, quality_rules.WITHOUT_WORDS * none)
        assert r["kept"] == (not r["base_failed"] and (c or 0) <= quality_rules.MAX_CHAR_DISTANCE and (d or 0) <= limit)


# one model, however the tables are dealt


def test_models_do_not_depend_on_partitions(spark, docs, labels):
    other, marks = docs.repartition(7, "text"), labels.repartition(5)
    a, b = (language.fit(d, fold("id", 4) != 2, per_language=20, most_rows=60) for d in (docs, other))
    assert language.dump(a) == language.dump(b)
    a, b = (quality_model.fit(d, x, fold("id", 3) != 1, most_rows=25) for d, x in ((docs, labels), (other, marks)))
    assert a["bias"] == b["bias"] and (a["w"] == b["w"]).all() and (a["v"] == b["v"]).all()
    a, b = (mixing.fit(d, domains_of(x), DOMAINS, most_rows=30) for d, x in ((docs, labels), (other, marks)))
    assert a == b
    taught = common.taught_rows(docs, labels.union(labels).select(F.col("doc_id").alias("id"), "quality"), ["quality"], "doc_id", "text", 30, 1)
    assert taught.count() <= 30


# odd columns and rows


def test_clashing_columns_pass(spark, labels):
    names = ["doc_id", "text", "mixing_words_few", "mixing_words_few_s", "mixing_words_n", "quality_score", "equal_rows", "dealt_doc", "a.b", "odd`name", "block", "n_chars"]
    rows = [(i, f"some words of text number {i} the and of", *["x"] * 9, 3) for i in range(30)]
    df = spark.createDataFrame(rows, names).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    assert mixing.mixed(df, domains_of(labels), DOMAINS, mixing.factors_of({}, DOMAINS)).columns == df.columns
    assert quality_model.accepted(df, labels, F.lit(True)).columns == df.columns
    assert substring_dedup.without_repeats(df).columns == df.columns
    assert ngram_join.one_of_each(df.union(df.limit(2)), 5, 80).columns == df.columns


def test_rows_without_an_id_stay_beside_repeated_ones(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(None, t, {"k": 1}), (None, t, {"k": 1}), (1, t, {"k": 1}), (1, t, {"k": 1}), (1, t + " x", {"k": 1}), (2, t, {"k": 2}), (3, "", None), (4, None, None), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in ngram_join.one_of_each(df, 5, 80).collect()), key=str)
    assert got == sorted([(0, t), (0, t), (1, t), (1, t + " x"), (3, ""), (4, None)], key=str)
    alone = df.where("doc_id is null or doc_id = 2")
    assert ngram_join.one_of_each(alone, 5, 80).where("doc_id is null").count() == 2


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n.split()[0] for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    """Null, empty and very long texts, ties, repeated rows, an empty table, and columns with clashing names."""
    good = table(spark, SF, "documents").where("doc_id < 20").withColumns({"block": F.lit(1), "Score": F.lit("s")})
    odd = [(9001, None), (9002, ""), (9003, " \n "), (9004, "ab " * 100000), (9004, "ab " * 100000), (None, "no id but words")]
    more = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("block"), F.lit("s").alias("Score"))
    rows = good.unionByName(more)
    out, none = stage(spark, rows, SF), stage(spark, rows.limit(0), SF)
    assert none.count() == 0 and out.columns == none.columns
    if stage is corpus_pipeline.pack:
        assert out.where("start + length = doc_tokens").count() == rows.count()  # each row's last piece
        return
    assert out.columns == rows.columns
    ids = [r["doc_id"] for r in out.collect()]
    if stage is corpus_pipeline.near_duplicates:
        assert {9001, 9002, 9003, None} <= set(ids) and ids.count(9004) == 1
    if stage is corpus_pipeline.repeats:
        assert {9001, 9002, 9003, None} <= set(ids) and ids.count(9004) == 2


# blocks and waves


def test_blocks_grow_with_the_input():
    memory = 4 << 30
    count = lambda total: max(common.LEAST_BLOCKS, -(-total // common.block_bytes(total, memory)))
    assert common.block_bytes(10 << 30, memory) == common.BLOCK_BYTES
    assert count(500 << 30) <= common.MANY_BLOCKS and common.block_bytes(500 << 30, memory) <= memory // common.TIMES_BLOCK
    assert common.block_bytes(100 << 40, memory) == memory // common.TIMES_BLOCK
    assert common.block_bytes(100 << 40, 1) == common.BLOCK_BYTES


def test_top_k_in_waves(spark, monkeypatch):
    """Many small blocks on both sides: later waves start from the scores of those before."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(3)
    m = rng.normal(0, 0.2, (140, 24))
    m[100:120] = m[20:40]  # ties across blocks
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    q = np.floor(64 * m).astype(int)
    want = []
    for i in range(0, 140, 20):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(140) if j != i)[:20]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == sorted(want)


def test_large_groups_of_several_sizes(spark, monkeypatch):
    """A group far over a chunk whose sets differ in size: chunks of neighbouring classes still meet."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base[: 60 + (i * 7) % 30] + ([f"c{i}"] if rng.random() < 0.5 else []))) for i in range(45)]
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for _, t in rows]
    label = list(range(45))
    for _ in range(45):
        for i in range(45):
            for j in range(45):
                if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()} == dict(enumerate(label))


def test_digests_that_clash_in_one_half(spark, monkeypatch):
    """With 256 nodes for 400 different sets, sets are still known by their whole digests."""
    monkeypatch.setattr(ngram_join, "NODE_BYTES", 1)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one = [" ".join(word() for _ in range(12)) for _ in range(400)]
    shared = [word() for _ in range(30)]
    near = [" ".join([*shared, *(["x"] if i else [])]) for i in range(2)]
    rows = list(enumerate([*one, *one[:50], *near, *near]))
    want = {i: i if i < 400 else i - 400 if i < 450 else 450 for i, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()} == want
