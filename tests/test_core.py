import cmath
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import align, corpus, stitch
from corpusloom.operators.lookup import Corpus
from corpusloom.sources import readers, schemas, sinks, sqlite
from corpusloom.sources.schemas import KEYS, TABLES

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("code, out", [(0x064B, ""), (0x065F, ""), (0x06D6, ""), (0x06DC, ""), (0x0670, "ا"), (0x0622, "ا"), (0x0623, "ا"), (0x0625, "ا"), (0x0629, "ه"), (0x0649, "ي"), (0x064A, "ي"), (0x0660, "٠"), (0x06D5, "ە"), (0x06DD, "۝"), (0x0671, "ٱ")])
def test_normalize(spark, code, out):
    assert one(spark, "x" + chr(code) + "y", T.normalize) == "x" + out + "y"


@pytest.mark.parametrize("text", ["", "   ", "١٢", " ١۲\n", " ١", "١a", "١ ٢", "\x1c١\x1f", "12"])
def test_marker_strip_and_tokens(spark, text):
    stripped = text.strip()
    assert one(spark, text, T.strip) == stripped
    assert one(spark, text, T.tokens) == text.split()
    assert one(spark, text, T.is_marker) == (bool(stripped) and all(0x660 <= ord(c) <= 0x669 or 0x6F0 <= ord(c) <= 0x6F9 for c in stripped))


def model_stitch(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[3]))
    if len(rows) == 1:
        return rows[0][2]
    cov, out = 0, []
    for start, end, text, _ in rows:
        if end <= cov:
            continue
        toks, over = text.split(), max(cov - start, 0)
        drop = 0 if not over else over if len(toks) == end - start else over * len(toks) // (end - start)
        out += toks[drop:]
        cov = end
    return " ".join(out)


def test_stitch_matches_a_sequential_model(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(60):
        own = []
        for i in range(rng.randint(1, 6)):
            start = rng.randint(0, 12)
            own.append((start, start + rng.randint(1, 6), "  ".join(f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 7))), i))
        want[g] = model_stitch(own)
        rows += [(g, s, e, t, i, i / 8, f"r{i}") for s, e, t, i in own]
    df = spark.createDataFrame(rows, "g int, w_start long, w_end long, phonemes string, seq long, match_ratio double, reciter string")
    assert {r["g"]: r["phonemes"] for r in stitch.stitch(df, ["g"]).collect()} == want


def test_offsets_matches_a_sequential_model(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(80):
        raw, merged = ("".join(rng.choice("ab  ") for _ in range(rng.randint(1, 9))) for _ in range(2))
        rows.append((g, raw, merged))
        places = [i for i, c in enumerate(merged) if c != " "]
        solid = [i for i, c in enumerate(raw) if c != " "]
        at = {i: places[k] if k < len(places) else len(merged) + k - len(places) for k, i in enumerate(solid)}
        end = at[solid[-1]] + 1 if solid else 0
        want[g] = [at[min(j for j in solid if j >= i)] if any(j >= i for j in solid) else end for i in range(len(raw))]
    df = spark.createDataFrame(rows, "g int, raw string, merged string")
    got = {r["g"]: r["pos"] for r in df.select("g", align.offsets(F.col("raw"), F.col("merged")).alias("pos")).collect()}
    assert {g: pos[:-1] for g, pos in got.items()} == want
    for g, raw, _ in rows:  # the end lies after the last character that isn't a blank
        solid = [i for i, c in enumerate(raw) if c != " "]
        assert len(got[g]) == len(raw) + 1 and got[g][-1] == (want[g][solid[-1]] + 1 if solid else 0)


def test_spans_with_a_missing_part(spark):
    df = spark.createDataFrame([("abcabd", ["ab", "zz", "ab", ""])], "s string, p array<string>")
    got = [tuple(x) for x in df.select(align.spans(F.col("s"), F.col("p")).alias("x")).first()["x"]]
    assert got == [(0, 2), (2, 4), (4, 6), (6, 6)]


def test_prefix_merge_and_identity(spark):
    df = spark.createDataFrame([(["x"],), (["Ta", "Tb", "c", "d"],), (["Ta", "b"],), (["Ta", "Tb"],), (["a", "Tb"],)], "t array<string>")
    assert [r["x"] for r in df.select(T.merge_leading(F.col("t"), ["T"]).alias("x")).collect()] == ["x", "TaTb c d", "Ta b", "TaTb", "a Tb"]
    rows = spark.createDataFrame([(1, 3, [(1, 2)]), (2, 2, None), (3, 0, []), (4, 1, [])], f"k int, n int, pairs {align.MAP}")
    got = align.rows_from(rows.select("k", align.or_identity(F.col("pairs"), F.col("n")).alias("z")), ["k"], "z").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 1, 1), (2, 2, 2), (4, 1, 1)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"1:1:1": {"id": 1, "text": "a"}, "1:1:2": {"id": 2}, "bad": {"id": 3, "text": "x"}}')
    got = readers.keyed_words(readers.read_json_map(spark, str(tmp_path / "w.json"), readers.WORD)).orderBy("word").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1, "a"), (1, 1, 2, 2, "")]
    assert readers.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    paths = spark.createDataFrame([("s3/moshaf_1.0/part.parquet",), ("s3/moshaf_2/metadata/x.parquet",), ("s3/other/x.parquet",)], "p string")
    assert [r["x"] for r in paths.select(readers.config_of(F.col("p")).alias("x")).collect()] == ["moshaf_1.0", "", ""]
    rows = spark.createDataFrame([("k", "g"), ("k", "h")], "key string, glyph string")
    with pytest.raises(ValueError):
        sinks.write_table(rows, str(tmp_path / "t"), "ligatures")
    sinks.write_table(rows.limit(1), str(tmp_path / "t"), "ligatures")
    assert spark.read.parquet(str(tmp_path / "t" / "ligatures")).count() == 1
    df = spark.createDataFrame([(1, "é", ["a"]), (2, None, [])], "n int, s string, c array<string>")
    assert [r["value"] for r in sinks.json_rows(df, ["n", "s", "c"]).collect()] == ['[1,"é",["a"]]', "[2,null,[]]"]
    assert set(KEYS) == set(TABLES)


def test_lookups(spark):
    t = {
        "words": spark.createDataFrame([(1, 1, 1, 1, "a"), (1, 1, 2, 2, "b"), (1, 2, 1, 3, "c")], "surah int, ayah int, word int, word_id int, text string"),
        "pages": spark.createDataFrame([(1, 1, None, None), (1, 2, 1, 2), (2, 1, 3, 3)], "page_number int, line_number int, first_word_id int, last_word_id int"),
        "ayahs": spark.createDataFrame([(1, 1, "a b"), (1, 2, "c")], "surah int, ayah int, text string"),
        "surahs": spark.createDataFrame([(1, "One", 2, 1)], "id int, name_simple string, verses_count int, bismillah_pre int"),
    }
    c = Corpus(t)
    assert c.page_for_position(1, 2).first()[0] == 2
    assert tuple(c.first_position_on_page(1).first()) == (1, 1)
    assert c.total_pages().first()[0] == 2
    assert [r["text"] for r in c.words(1, 1).collect()] == ["a", "b"]
    assert c.has_ayah(1, 3).first()[0] is False
    assert c.ayahs((1, 1), (1, 2)).count() == 2
    assert c.has_bismillah(1).first()[0] is True


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1.0, 1.0, 4.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    r = df.select(V.max_abs(a, b).alias("m"), V.mean_abs(a, b).alias("e"), V.argmax(a).alias("i"), V.quantized(a).alias("q")).first()
    assert (r["m"], r["e"], r["i"], r["q"]) == (2.0, 1.0, 1, [42, 127, 127])


def test_registered_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from corpusloom.plans import catalog

    assert len(catalog.ORACLE_SQL) > 80

    con = duckdb.connect()
    for name in ["region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"]:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")

    def rows(found):
        names = sorted(found.columns)
        return sorted((tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in found[names].itertuples(index=False, name=None)), key=str)

    for name in catalog.QUERIES:
        if name not in catalog.ORACLE_SQL:
            assert entry.queries()[name](spark, SF).count() > 0, name
            continue
        got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
        if len(got) < 20000:
            assert str(rows(got)) == str(rows(want)), name
            continue
        con.register("got", got)
        con.register("want", want)
        names = ", ".join(f'"{c}"' for c in sorted(got.columns))
        both = [con.execute(f"select count(*) from (select {names} from {x} except all select {names} from {y})").fetchall()[0][0] for x, y in (("got", "want"), ("want", "got"))]
        assert both == [0, 0], name


def test_palettes_and_local_alignment(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.choice([-2, -1, 0.5, 3]) + rng.random() * 0.01) for _ in range(40)]) for i in range(5)] + [(9, [1.0, 2.0]), (10, None)]
    df = spark.createDataFrame(rows, "i int, a array<float>")
    got = {r["i"]: r["p"] for r in df.select("i", V.palettized(F.col("a"), 2).alias("p")).collect()}
    for i, a in rows[:5]:
        assert len(set(got[i])) <= 4 and max(abs(x - y) for x, y in zip(a, got[i])) < 0.02
    assert got[9] == [1.0, 2.0] and got[10] is None

    def brute(a, b):
        """The best global score of any two stretches."""
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                h = {(0, 0): 0}
                for x in range(len(a) - i + 1):
                    for y in range(len(b) - j + 1):
                        ways = [h[x, y - 1] - 1] if y else []
                        ways += [h[x - 1, y] - 1] if x else []
                        ways += [h[x - 1, y - 1] + (2 if a[i + x - 1] == b[j + y - 1] else -1)] if x and y else []
                        if ways:
                            h[x, y] = max(ways)
                best = max(best, max(h.values()))
        return best

    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(30)]
    out = spark.createDataFrame(pairs, "a array<string>, b array<string>").coalesce(1).select("a", "b", align.local(F.col("a"), F.col("b")).alias("z")).select("a", "b", "z.*").collect()
    for r in out:
        assert r["score"] == brute(r["a"], r["b"])
        x, y = r["a"][r["heard_start"] : r["heard_end"]], r["b"][r["known_start"] : r["known_end"]]
        assert brute(x, y) == r["score"] and (r["score"] == 0) == (not x and not y)


def test_sqlite_and_enforced_schemas(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute('create table "odd name" (id integer primary key, "text x" text, r real)')
        con.executemany('insert into "odd name" values (?, ?, ?)', [(i * 3, None if i == 2 else f"t{i}", i / 2) for i in range(20)])
        con.execute("create table empty (id integer)")
    con.close()
    got = sqlite.read_sqlite(spark, str(tmp_path / "x.db"), "odd name", ["text x", "id"])
    assert got.dtypes == [("text x", "string"), ("id", "bigint")]
    assert sorted((r["id"], r["text x"]) for r in got.collect()) == [(i * 3, None if i == 2 else f"t{i}") for i in range(20)]
    assert sqlite.read_sqlite(spark, str(tmp_path / "x.db"), "empty").count() == 0
    rows = spark.createDataFrame([(1, 1, 1, "a", None), (1, 1, 1, "b", "n"), (1, 2, 1, None, "n")], "surah long, ayah int, word int, text string, normalized_text string")
    found = {r["rule"]: r["n"] for r in schemas.violations(schemas.conformed(rows, "imlai_words"), "imlai_words").collect()}
    assert found == {"not null text": 1, "not null normalized_text": 1, "primary key": 1}
    with pytest.raises(ValueError, match="not null text"):
        sinks.write_table(rows, str(tmp_path / "t"), "imlai_words")
    assert not (tmp_path / "t").exists()
    sinks.write_table(spark.createDataFrame([(1, 1, "ayah")], "page_number int, line_number int, line_type string"), str(tmp_path / "t"), "pages")
    assert tuple(spark.read.parquet(str(tmp_path / "t" / "pages")).first()) == (1, 1, "ayah", 0, None, None, None)


def test_folders_and_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("b", "é\"x"), ("a", None), ("c", "z")], "k string, v string")
    rows.write.parquet(str(tmp_path / "moshaf_2" / "train"))
    rows.write.parquet(str(tmp_path / "moshaf_1"))
    rows.write.parquet(str(tmp_path / "other"))
    rows.write.parquet(str(tmp_path / "moshaf_3" / "metadata"))
    assert [r[0] for r in readers.configs(spark, str(tmp_path)).collect()] == ["moshaf_1", "moshaf_2"]
    one = readers.directory_size(spark, str(tmp_path), 1 << 20).first()
    assert one["bytes"] == sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))) and one["size"] == one["bytes"] / (1 << 20)
    lines = [r["value"] for r in sinks.json_map_lines(rows, "k", "v").collect()]
    assert json.loads("\n".join(lines)) == {"a": None, "b": 'é"x', "c": "z"} and lines[1] == '  "a": null,'
    lines = [r["value"] for r in sinks.json_array_lines(rows, ["v", "k"], ["k"]).collect()]
    assert json.loads("\n".join(lines)) == [[None, "a"], ['é"x', "b"], ["z", "c"]]
    tensors = readers.seeded_tensor(spark, 5, 3)
    assert tensors.collect() == readers.seeded_tensor(spark, 5, 3).collect() and len(tensors.first()["features"]) == 3
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(V.same_size(F.col("a"), F.col("b"))).collect()


def test_mel_frames(spark):
    """Two frames against a transform written out as sums."""
    rng = random.Random(2)
    samples = [rng.uniform(-0.5, 0.5) for _ in range(600)]
    bank = [[1.0 if 10 * b <= k < 10 * b + 15 else 0.0 for k in range(257)] for b in range(3)]
    df = spark.createDataFrame([(1, samples), (2, samples[:399]), (3, None)], "i int, x array<double>")
    got = {r["i"]: r["m"] for r in df.select("i", V.mel_frames(F.col("x"), np.array(bank)).alias("m")).collect()}
    assert got[2] == [] and got[3] is None and len(got[1]) == 2
    for f, frame in enumerate(got[1]):
        x = [32768 * v for v in samples[160 * f : 160 * f + 400]]
        x = [v - sum(x) / 400 for v in x]
        y = [(v - 0.97 * (x[i - 1] if i else x[0])) * (0.5 - 0.5 * math.cos(2 * math.pi * i / 400)) for i, v in enumerate(x)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * i * k / 512) for i, v in enumerate(y))) ** 2 for k in range(40)]
        assert frame == pytest.approx([math.log(sum(power[10 * b : 10 * b + 15])) for b in range(3)], rel=1e-5)


def test_frames_without_variance(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [1.0, 4.0]]), (2, [[1.0, 2.0]]), (3, [])], "i int, f array<array<float>>")
    got = {r["i"]: r["s"] for r in df.select("i", V.standardized(F.col("f")).alias("s")).collect()}
    assert got[1] == [[0.0, pytest.approx(-math.sqrt(0.5))], [0.0, pytest.approx(math.sqrt(0.5))]] and got[2] == [[None, None]] and got[3] == []
