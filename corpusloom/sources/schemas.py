"""The nine output tables and their primary keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = {
    "surahs": "id int not null, name_arabic string not null, name_simple string not null, name_english string not null, verses_count int not null, revelation_place string, bismillah_pre int not null",
    "ligatures": "key string, glyph string not null",
    "ayahs": "surah int not null, ayah int not null, text string not null, phonemes string",
    "words": "surah int not null, ayah int not null, word int not null, word_id int not null, text string not null, glyph_text string",
    "word_map": "surah int not null, ayah int not null, phoneme_word int not null, text_word int not null",
    "phoneme_groups": "surah int not null, ayah int not null, group_idx int not null, group_text string not null, ph_start int not null, ph_end int not null, uthmani_word int not null",
    "phoneme_char_map": "surah int not null, ayah int not null, uthmani_idx int not null, ph_start int not null, ph_end int not null, deleted int not null, uthmani_word int not null",
    "pages": "page_number int not null, line_number int not null, line_type string not null, is_centered int not null, first_word_id int, last_word_id int, surah_number int",
    "imlai_words": "surah int not null, ayah int not null, word int not null, text string not null, normalized_text string not null",
}
KEYS = {
    "surahs": ["id"], "ligatures": ["key"], "ayahs": ["surah", "ayah"], "words": ["surah", "ayah", "word"], "word_map": ["surah", "ayah", "phoneme_word", "text_word"],
    "phoneme_groups": ["surah", "ayah", "group_idx"], "phoneme_char_map": ["surah", "ayah", "uthmani_idx"], "pages": ["page_number", "line_number"], "imlai_words": ["surah", "ayah", "word"],
}


#: What a missing value becomes.
DEFAULTS = {"surahs": {"bismillah_pre": 1}, "pages": {"is_centered": 0}, "phoneme_groups": {"uthmani_word": 0}, "phoneme_char_map": {"deleted": 0, "uthmani_word": 0}}


def columns_of(name: str) -> list[tuple[str, str, bool]]:
    """(column, type, whether it must have a value) of a table."""
    return [(x.split()[0], x.split()[1], x.endswith("not null")) for x in TABLES[name].split(", ")]


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order, cast to their types (a value that doesn't fit raises), defaults for missing values."""
    given, defaults = set(df.columns), DEFAULTS.get(name, {})

    def one(column: str, kind: str) -> Column:
        value = F.col(column) if column in given else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(defaults[column]).cast(kind)) if column in defaults else value.cast(kind)

    return df.select(*[one(c, kind).alias(c) for c, kind, _ in columns_of(name)])


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, n): for each column that must have a value how many rows have none, and how many keys repeat; only what is broken."""
    needed = [c for c, _, must in columns_of(name) if must]
    cells = [F.struct(F.concat(F.lit("not null "), F.lit(c)).alias("rule"), F.count_if(F.col(c).isNull()).alias("n")) for c in needed]
    repeated = duplicates(df, KEYS[name]).agg(F.lit("primary key").alias("rule"), F.count("*").alias("n"))
    missing = df.agg(F.array(*cells).alias("x")).select(F.inline("x")) if cells else repeated.limit(0)
    return missing.unionByName(repeated).where("n > 0")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
