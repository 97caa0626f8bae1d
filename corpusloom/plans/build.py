"""The nine tables from their sources, as one plan a table.

What a phonetizer gives is an input: a verse's text, its phonemes, and for each character of the text the range of phonemes that
it makes. How phonemes part into groups is a function of the caller's. Verses without either get what can be had: spare
phonemes, and a word map of each word to itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import align, corpus
from corpusloom.sources import sinks
from corpusloom.sources.schemas import TABLES

KEYS = ["surah", "ayah"]
# Phonemes of verses for which the phonetizer fails.
SPARE_PHONEMES = {
    "55:17": "رَببُ لمَشرِقَينِ وَرَببُ لمَغرِبَين",
    "90:8": "ءَلَم نَجڇعَللَهُۥۥ عَينَين",
    "90:9": "وَلِسَاانَوووَشَفَتَين",
    "90:10": "وَهَدَينَااهُ ننننَجڇدَين",
    "106:1": "لِءِۦۦلَاافِ قُرَيش",
    "106:2": "ءِۦۦلَاافِهِم رِحلَتَ ششِتَااااءِ وَصصَيف",
    "106:3": "فَليَعبُدُۥۥ رَببَ هَااذَ لبَيت",
    "106:4": "ءَللَذِۦۦ ءَطڇعَمَهُممممِںںںجُۥۥعِوووَءَاامَنَهُممممِن خَوف",
}


@dataclass
class Inputs:
    """words: surah, ayah, word, word_id, text. glyphs: word_id, glyph_text, seq. plain: surah, ayah, word, text, seq.
    phonetized: surah, ayah, uthmani, raw, mappings (array<struct<start: int, end: int, deleted: boolean>>).
    spare: surah, ayah, phonemes. The rest are tables as they will be. groups_of: phonemes to their groups in order."""

    words: DataFrame
    glyphs: DataFrame
    plain: DataFrame
    phonetized: DataFrame
    spare: DataFrame
    surahs: DataFrame
    ligatures: DataFrame
    pages: DataFrame
    groups_of: Callable[[Column], Column] = T.tokens


def spare_phonemes(spark: SparkSession) -> DataFrame:
    """SPARE_PHONEMES as a table: surah, ayah, phonemes."""
    fits, (s, a) = T.key_parts(F.col("key"), 2)
    return spark.createDataFrame(list(SPARE_PHONEMES.items()), "key string, phonemes string").where(fits).select(s.alias("surah"), a.alias("ayah"), "phonemes")


VERSE = ["uthmani", "raw", "mappings"]


def with_boundaries(phonetized: DataFrame) -> DataFrame:
    """(surah, ayah, phonemes) with a blank wherever the text's words change; an empty text where there are none."""
    return phonetized.select(*KEYS, align.of_verses("string", align.Verse.phonemes, *map(F.col, VERSE)).alias("phonemes"))


def verse_phonemes(words: DataFrame, generated: DataFrame, spare: DataFrame) -> DataFrame:
    """(surah, ayah, phonemes) of verses that have words: generated ones, else spare ones. Spelled-out letters at the start
    become one word where the verse's first word allows it."""
    p = F.col("phonemes")
    rows = with_preferred(words.groupBy(*KEYS).agg(first_word()), generated, spare).where(p.isNotNull())
    return rows.select(*KEYS, merged(p, F.col("first")).alias("phonemes"))


def first_word() -> Column:
    """`first`: of a verse's words, the first that isn't a marker; null if there is none."""
    first = F.min_by("text", F.when(~T.is_marker(F.col("text")), F.col("word")))
    return F.when(F.count_if(~T.is_marker(F.col("text"))) > 0, first).alias("first")


def with_preferred(verses: DataFrame, generated: DataFrame, spare: DataFrame) -> DataFrame:
    """verses with the columns of generated; phonemes: generated ones, else spare ones, else null."""
    rows = verses.join(generated, KEYS, "left").join(spare.withColumnRenamed("phonemes", "other"), KEYS, "left")
    return rows.withColumn("phonemes", corpus.preferred(F.col("phonemes"), F.col("other"))).drop("other")


def merged(phonemes: Column, first: Column) -> Column:
    """Phonemes, with spelled-out letters at the start as one word where the verse's first word allows it."""
    t = T.tokens(phonemes)
    several = (F.size(t) > 1) & T.has_prefix(F.get(t, 0), T.LETTER_NAMES) & T.has_prefix(F.get(t, 1), T.LETTER_NAMES)
    return F.when(F.coalesce(T.is_opening(first), F.lit(False)) & several, T.merge_leading(t, T.LETTER_NAMES)).otherwise(phonemes)


def build(given: Inputs) -> dict[str, DataFrame]:
    """Table name to plan."""
    known = given.phonetized.join(given.words.select(*KEYS).distinct(), KEYS, "left_semi")
    phonemes = verse_phonemes(given.words, with_boundaries(known), given.spare)
    both = known.join(phonemes, KEYS)
    heard = [*map(F.col, VERSE), F.col("phonemes")]
    char_map = align.rows_from(both.select(*KEYS, align.of_verses(align.CHARACTERS, align.Verse.characters, *heard).alias("z")), KEYS, "z")

    groups = both.withColumn("group_text", given.groups_of(F.col("phonemes"))).withColumn("span", align.spans(F.col("phonemes"), F.col("group_text"), 0))
    groups = groups.withColumn("uthmani_word", align.of_verses("array<int>", align.group_words, *heard, F.col("span")))
    each = lambda z, i: F.struct(i.alias("group_idx"), z["group_text"].alias("group_text"), z["span"]["start"].alias("ph_start"), z["span"]["end"].alias("ph_end"), z["uthmani_word"].alias("uthmani_word"))
    groups = align.rows_from(groups.select(*KEYS, F.transform(F.arrays_zip("group_text", "span", "uthmani_word"), each).alias("z")), KEYS, "z")

    tokens = both.withColumn("span", align.spans(F.col("phonemes"), T.tokens(F.col("phonemes")), 1))
    pairs = tokens.select(*KEYS, align.of_verses(align.MAP, align.token_words, *heard, F.col("span")).alias("pairs"))
    counts = phonemes.select(*KEYS, F.size(T.tokens(F.col("phonemes"))).alias("n")).join(pairs, KEYS, "left")
    word_map = align.rows_from(counts.select(*KEYS, align.or_identity(F.col("pairs"), F.col("n")).alias("z")), KEYS, "z")

    plain = corpus.plain_words(given.plain, [*KEYS, "word", "seq"])
    out = {
        "surahs": given.surahs,
        "ligatures": given.ligatures,
        "ayahs": corpus.verses_of(corpus.verse_texts(given.words, KEYS), phonemes, KEYS),
        "words": corpus.with_glyphs(given.words, given.glyphs),
        "word_map": word_map,
        "phoneme_groups": groups,
        "phoneme_char_map": char_map,
        "pages": given.pages,
        "imlai_words": sinks.last_wins(plain, [*KEYS, "word"], ["seq"]),
    }
    names = {name: [x.split()[0] for x in ddl.split(", ")] for name, ddl in TABLES.items()}
    return {name: df.select(*names[name]) for name, df in out.items()}


def write(tables: dict[str, DataFrame], root: str) -> None:
    """Writes every table: first those that need no mapping, then the three that do."""
    late = ["word_map", "phoneme_groups", "phoneme_char_map"]
    for name in [*(n for n in tables if n not in late), *late]:
        sinks.write_table(tables[name], root, name)


def keep_last_run(generated: DataFrame, before: DataFrame) -> DataFrame:
    """(surah, ayah, phonemes): a run's phonemes, and the last run's for verses on which this one failed (null)."""
    rows = generated.join(before.withColumnRenamed("phonemes", "old"), KEYS, "left")
    return rows.select(*KEYS, F.coalesce("phonemes", "old").alias("phonemes")).where(F.col("phonemes").isNotNull())


def counters(given: Inputs) -> DataFrame:
    """One row: verses; those whose phonemes were generated, were spare, or are missing; plain words imported and skipped."""
    known = given.phonetized.join(given.words.select(*KEYS).distinct(), KEYS, "left_semi")
    made = with_boundaries(known).select(*KEYS, F.when(F.length("phonemes") > 0, True).alias("made"))
    spare = given.spare.where(F.length("phonemes") > 0).select(*KEYS, F.lit(True).alias("spare"))
    rows = given.words.select(*KEYS).distinct().join(made, KEYS, "left").join(spare, KEYS, "left")
    one = rows.agg(
        F.count("*").alias("verses"), F.count("made").alias("generated"), F.count_if(F.col("made").isNull() & F.col("spare").isNotNull()).alias("fallback"),
        F.count_if(F.col("made").isNull() & F.col("spare").isNull()).alias("missing"),
    )
    stripped = T.strip(F.col("text"))
    plain = given.plain.agg(F.count("*").alias("all"), F.count_if((stripped != "") & ~T.is_marker(F.col("text"))).alias("imported"))
    return one.crossJoin(plain).select("verses", "generated", "fallback", "missing", "imported", (F.col("all") - F.col("imported")).alias("skipped"))  # single rows


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table, and verses with phonemes and pages counted once."""
    extra = {"ayahs": ("ayahs with phonemes", F.count("phonemes")), "pages": ("distinct pages", F.count_distinct("page_number"))}
    out = None
    for name, df in tables.items():
        cells = [F.struct(F.lit(name).alias("name"), F.count("*").alias("n"))]
        if name in extra:
            cells.append(F.struct(F.lit(extra[name][0]).alias("name"), extra[name][1].alias("n")))
        one = df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
        out = one if out is None else out.unionByName(one)
    return out


def statistics_of(given: Inputs) -> DataFrame:
    """As `statistics(build(given))`, without building the tables: the words become verses once, a verse's rows in each table are
    counted where its arrays are, and no array is taken apart. Verses are unique in phonetized and spare, as the key of ayahs demands."""
    heard = given.phonetized.select(*KEYS, *VERSE, align.of_verses("string", align.Verse.phonemes, *map(F.col, VERSE)).alias("phonemes"))
    rows = with_preferred(given.words.groupBy(*KEYS).agg(first_word(), F.count("*").alias("words")), heard, given.spare)
    p = F.col("spoken")
    rows = align.fixed(rows, "spoken", merged(F.col("phonemes"), F.col("first")))
    rows = rows.withColumn("pairs", align.of_verses("array<int>", align.token_pairs, *map(F.col, VERSE), p)[0])
    known = p.isNotNull()
    for c in VERSE:
        known &= F.col(c).isNotNull()
    n = F.size(T.tokens(p))
    each = {
        "ayahs": F.count("*"), "ayahs with phonemes": F.count(p), "words": F.sum("words"), "word_map": F.sum(F.when(F.col("pairs") > 0, F.col("pairs")).when(p.isNotNull(), n)),
        "phoneme_groups": F.sum(F.when(known, F.greatest(F.size(given.groups_of(p)), F.lit(0)))), "phoneme_char_map": F.sum(F.when(known, F.size("mappings"))),
    }
    text = F.col("text")
    plain = given.plain.where(T.has_sign(text) & ~T.is_marker(text)).select(*KEYS, "word").distinct()
    parts = [
        (rows, each), (given.surahs, {"surahs": F.count("*")}), (given.ligatures, {"ligatures": F.count("*")}),
        (given.pages, {"pages": F.count("*"), "distinct pages": F.count_distinct("page_number")}), (plain, {"imlai_words": F.count("*")}),
    ]
    out = None
    for df, cells in parts:
        one = df.agg(F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(value, F.lit(0)).cast("long").alias("n")) for name, value in cells.items()]).alias("x")).select(F.inline("x"))
        out = one if out is None else out.unionByName(one)
    return out
