"""Rows counted from one pass over verses are those of the tables that are built."""

import random

from corpusloom.functions import text as T
from corpusloom.plans import build, lookups


def test_counts_are_those_of_the_built_tables(spark):
    rng, words, heard = random.Random(5), [], []
    for a in range(1, 31):
        text = [rng.choice(["ab", "c", "٣", "dd"]) for _ in range(rng.randint(1, 5))]
        words += [(1, a, k, 100 * a + k, w) for k, w in enumerate(text, 1)]
        uthmani, raw, mappings = " ".join(text), "", []
        for _ in uthmani:
            size = rng.choice([0, 1, 1, 2])
            mappings.append((len(raw), len(raw) + size, rng.random() < 0.2))
            raw += "".join(rng.choice("xy ") for _ in range(size))
        heard.append((1, a, *rng.choice([(uthmani, raw, mappings)] * 6 + [(uthmani, "", mappings), (uthmani, raw, None), (None, raw, mappings)])))
    opening = f"{T.LETTER_NAMES[0]}x {T.LETTER_NAMES[1]}y z"
    words += [(2, 1, 1, 9001, "الٓ"), (2, 2, 1, 9002, "plainword"), (2, 3, 1, 9003, None), (None, None, 1, 9004, "x")]
    keys = "surah int, ayah int"
    given = build.Inputs(
        words=spark.createDataFrame(words, f"{keys}, word int, word_id int, text string"),
        glyphs=spark.createDataFrame([(101, "old", 1), (101, "new", 2)], "word_id int, glyph_text string, seq int"),
        plain=spark.createDataFrame([(1, 1, 1, " a ", 1), (1, 1, 1, "b", 2), (1, 1, 2, " ٣ ", 3), (1, 1, 3, "\x1c  ", 4), (1, 1, 4, None, 5), (1, 1, 5, "", 6), (None, 1, 1, "x", 7)], f"{keys}, word int, text string, seq int"),
        phonetized=spark.createDataFrame([*heard, (7, 7, "no words", "x", [(0, 1, False)])], f"{keys}, uthmani string, raw string, mappings array<struct<start: int, end: int, deleted: boolean>>"),
        spare=spark.createDataFrame([(1, a, "sp are") for a in range(1, 20)] + [(2, 1, opening), (2, 2, ""), (9, 9, "not a verse")], f"{keys}, phonemes string"),
        surahs=spark.createDataFrame([(1, "a", "One", "b", 30, None, 1)], "id int, name_arabic string, name_simple string, name_english string, verses_count int, revelation_place string, bismillah_pre int"),
        ligatures=spark.createDataFrame([("k", "g")], "key string, glyph string"),
        pages=spark.createDataFrame([(1, 1, "ayah", 0, 1, 9, None), (1, 2, "ayah", 0, 10, 19, None)], "page_number int, line_number int, line_type string, is_centered int, first_word_id int, last_word_id int, surah_number int"),
    )
    want = sorted(map(tuple, build.statistics(build.build(given)).collect()))
    assert sorted(map(tuple, build.statistics_of(given).collect())) == want
    empty = build.Inputs(**{k: v.limit(0) if hasattr(v, "limit") else v for k, v in vars(given).items()})
    assert {n for _, n in build.statistics_of(empty).collect()} == {0}


def test_statistics_read_the_documents_a_few_times(spark):
    plan = lookups.build_statistics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= 8, plan.count("Relation [doc_id")
    assert plan.count("ArrowEvalPython") == 2
