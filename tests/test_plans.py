"""The two whole plans against sequential models of what they compute."""

import json
import random

import pytest

from corpusloom.functions import text as T
from corpusloom.operators.lookup import Corpus
from corpusloom.plans import build, recordings
from tests.test_core import model_stitch

OPENING = "الم"


def words_under(uthmani, mappings, n):
    """For each of n phonemes the words whose characters make it."""
    word_of = [0 if ch == " " else uthmani[:i].count(" ") + 1 for i, ch in enumerate(uthmani)]
    under = [set() for _ in range(n)]
    for word, (start, end, deleted) in zip(word_of, mappings):
        for k in range(start, min(end, n)):
            if word and not deleted:
                under[k].add(word)
    return word_of, under


def model_phonemes(raw, under):
    out, before = "", 0
    for ch, own in zip(raw, under):
        if ch != " ":
            now = min(own, default=before)
            out += (" " if now > before > 0 else "") + ch
            before = now
    return out


def model_tables(uthmani, raw, mappings, phonemes):
    """Rows of the three mapping tables of a verse."""
    word_of, under = words_under(uthmani, mappings, len(raw))
    mine, theirs = [i for i, c in enumerate(raw) if c != " "], [i for i, c in enumerate(phonemes) if c != " "]
    theirs += [len(phonemes) + k for k in range(len(mine) - len(theirs))]
    move = dict(zip(mine, theirs))
    end = move[mine[-1]] + 1 if mine else 0

    def moved(p):
        return next((move[i] for i in range(min(p, len(raw)), len(raw)) if i in move), end)

    chars = [(i, moved(s), moved(e), int(d), word_of[i] if i < len(word_of) else 0) for i, (s, e, d) in enumerate(mappings)]
    at = {move[i]: under[i] for i in mine}
    held = lambda a, b: set().union(*(at.get(k, set()) for k in range(a, min(b, len(phonemes)))))
    groups, pairs, pos = [], set(), 0
    for k, token in enumerate(phonemes.split()):
        a = phonemes.index(token, pos)
        pos = a + len(token)
        groups.append((k, token, a, pos, min(held(a, pos), default=0)))
        pairs |= {(k + 1, w) for w in held(a, pos)}
    return chars, groups, pairs or {(k + 1, k + 1) for k in range(len(phonemes.split()))}


@pytest.fixture(scope="module")
def verses():
    rng = random.Random(3)
    out = []
    for a in range(1, 26):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        uthmani, raw, mappings = " ".join(words), "", []
        for ch in uthmani:
            size = rng.choice([0, 1, 1, 2, 3])
            mappings.append((len(raw), len(raw) + size + rng.choice([0, 0, 0, 1]), rng.random() < 0.15))
            raw += "".join(rng.choice("xyz ") for _ in range(size))
        out.append((1, a, words, uthmani, raw, mappings))
    return out


def test_build_matches_a_sequential_model(spark, verses, tmp_path):
    rows, number = [], 0
    for s, a, words, *_ in verses:
        for k, w in enumerate([*words, "٣"], 1):
            number += 1
            rows.append((s, a, k, number, w))
    opening = f"{T.LETTER_NAMES[0]}x {T.LETTER_NAMES[1]}y z"
    rows += [(2, 1, 1, number + 1, OPENING), (2, 2, 1, number + 2, "plainword")]
    phonetized = [(s, a, u, r, [{"start": x, "end": y, "deleted": z} for x, y, z in m]) for s, a, _, u, r, m in verses]
    none = "surah int, ayah int"
    given = build.Inputs(
        words=spark.createDataFrame(rows, f"{none}, word int, word_id int, text string"),
        glyphs=spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "word_id int, glyph_text string, seq int"),
        plain=spark.createDataFrame([(1, 1, 1, " a ", 1), (1, 1, 1, "b", 2), (1, 1, 1, "٣", 3), (1, 1, 2, "", 4)], f"{none}, word int, text string, seq int"),
        phonetized=spark.createDataFrame(phonetized, f"{none}, uthmani string, raw string, mappings array<struct<start: int, end: int, deleted: boolean>>"),
        spare=spark.createDataFrame([(2, 1, opening), (2, 2, opening), (9, 9, "not a verse"), (1, 1, "spare")], f"{none}, phonemes string"),
        surahs=spark.createDataFrame([(1, "a", "One", "b", 25, None, 1)], "id int, name_arabic string, name_simple string, name_english string, verses_count int, revelation_place string, bismillah_pre int"),
        ligatures=spark.createDataFrame([("k", "g")], "key string, glyph string"),
        pages=spark.createDataFrame([(1, 1, "ayah", 0, 1, number, None)], "page_number int, line_number int, line_type string, is_centered int, first_word_id int, last_word_id int, surah_number int"),
    )
    build.write(build.build(given), str(tmp_path))
    t = {n: spark.read.parquet(str(tmp_path / n)) for n in ["ayahs", "words", "word_map", "phoneme_groups", "phoneme_char_map", "pages", "imlai_words", "surahs", "ligatures"]}
    want_ayahs, want_chars, want_groups, want_pairs = set(), set(), set(), set()
    for s, a, words, u, r, m in verses:
        p = model_phonemes(r, words_under(u, m, len(r))[1]) or ("spare" if a == 1 else None)
        want_ayahs.add((s, a, " ".join(words), p))
        if p is None:
            continue
        chars, groups, pairs = model_tables(u, r, m, p)
        want_chars |= {(s, a, *x) for x in chars}
        want_groups |= {(s, a, *x) for x in groups}
        want_pairs |= {(s, a, *x) for x in pairs}
    want_ayahs |= {(2, 1, OPENING, opening.replace(" ", "", 1)), (2, 2, "plainword", opening)}
    want_pairs |= {(2, 1, 1, 1), (2, 1, 2, 2), (2, 2, 1, 1), (2, 2, 2, 2), (2, 2, 3, 3)}
    assert set(map(tuple, t["ayahs"].collect())) == want_ayahs
    assert set(map(tuple, t["phoneme_char_map"].collect())) == want_chars
    assert set(map(tuple, t["phoneme_groups"].collect())) == want_groups
    assert set(map(tuple, t["word_map"].collect())) == want_pairs
    assert [tuple(r) for r in t["imlai_words"].collect()] == [(1, 1, 1, "b", "b")]
    assert {r["glyph_text"] for r in t["words"].where("word_id <= 2").collect()} == {"new", None}
    n = {r["name"]: r["n"] for r in build.statistics(t).collect()}
    assert n["words"] == len(rows) and n["distinct pages"] == 1 and n["ayahs with phonemes"] == sum(x[3] is not None for x in want_ayahs)
    assert Corpus(t).page_for_position(1, 1).first()[0] == 1


def test_last_run_fills_in(spark):
    spare = {(r["surah"], r["ayah"]): r["phonemes"] for r in build.spare_phonemes(spark).collect()}
    assert len(spare) == 8 and spare[55, 17] == build.SPARE_PHONEMES["55:17"]
    schema = "surah int, ayah int, phonemes string"
    now, before = spark.createDataFrame([(1, 1, "n"), (1, 2, None), (1, 3, None)], schema), spark.createDataFrame([(1, 1, "o"), (1, 2, "o"), (4, 4, "o")], schema)
    assert sorted(map(tuple, build.keep_last_run(now, before).collect())) == [(1, 1, "n"), (1, 2, "o")]


def test_extract_matches_a_sequential_model(spark):
    rng = random.Random(9)
    span = lambda v, w: {"sura_idx": 1, "aya_idx": v, "imlaey": w}
    rows, by = [], {}
    for i in range(160):
        v, w, config = rng.randint(1, 6), rng.randint(0, 5), f"moshaf_{rng.randint(1, 4)}"
        end, text = w + rng.randint(1, 4), " ".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
        last = v + (rng.random() < 0.1)
        good = rng.choice([True, True, True, True, None, False])
        start_span = None if rng.random() < 0.05 else span(v, w)
        rows.append((good, start_span, span(last, end), text, 0.5, "r", config, i))
        if good and start_span and last == v:
            by.setdefault((config, v), []).append((w, end, text, i))
    rows.append((True, span(1, 0), span(1, 1), "", 0.5, "r", "moshaf_1", 999))
    found: dict = {}
    for (config, v), own in sorted(by.items()):
        found.setdefault((v, model_stitch(own)), []).append(config.removeprefix("moshaf_"))
    want = sorted(([1, v, v, p, sorted(c)] for (v, p), c in found.items()), key=lambda r: (r[1], r[4][0]))
    s = "struct<sura_idx: int, aya_idx: int, imlaey: int>"
    df = spark.createDataFrame(rows, f"has_quran boolean, start_span {s}, end_span {s}, phonemes string, match_ratio double, reciter_english_name string, config string, seq int")
    assert [json.loads(r["value"]) for r in recordings.extract(df).collect()] == want
    one = recordings.summary(df).first()
    assert (one["total"], one["n_verses"], one["n_unique"]) == (161, len(by), len(want))
    names = spark.createDataFrame([("b",), ("a",), ("",), ("a",), ("c",)], "config string")
    assert [[r[0] for r in recordings.chosen(names, *x).collect()] for x in [("all",), ("", 2), ("c, a",)]] == [["a", "b", "c"], ["a", "b"], ["a", "c"]]
