"""Words, verses and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import MARKER, is_marker, normalize, strip


def verse_texts(words: DataFrame, keys: list[str]) -> DataFrame:
    """Each verse's words in order, by blanks, without markers; an empty text if there are only markers."""
    kept = F.when(~is_marker(F.col("text")), F.struct("word", "text"))
    parts = F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["text"])
    return words.groupBy(*keys).agg(F.array_join(parts, " ").alias("text"))


def with_glyphs(words: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Words with their glyph, null where there is none; of repeated glyph ids the last by seq counts. Spark picks the join by size."""
    last = glyphs.groupBy("word_id").agg(F.max_by("glyph_text", "seq").alias("glyph_text"))
    return words.join(last, "word_id", "left")


def verses_of(texts: DataFrame, phonemes: DataFrame, keys: list[str]) -> DataFrame:
    """All verses of either side: text (empty if missing) and phonemes (null if missing)."""
    return texts.join(phonemes, keys, "full").select(*keys, F.coalesce("text", F.lit("")).alias("text"), "phonemes")


def preferred(first: Column, second: Column) -> Column:
    """The first value unless it is null or empty, else the second."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def plain_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, normalized_text) of words that are neither empty nor markers once stripped. The generator keeps the
    optimiser from copying the strip into the filter and into each output."""
    stripped = F.transform(F.array(strip(F.col("text"))), lambda s: F.struct(s.alias("text"), normalize(s).alias("normalized_text")))
    return words.select(*keys, F.inline(F.filter(stripped, lambda z: (z["text"] != "") & ~z["text"].rlike(MARKER))))


def word_lines(lines: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """Words with the line whose range of word ids holds them. A line becomes a row for each id, so this is an
    equality join rather than a comparison of every word with every line."""
    some = lines.where(F.col("first_word_id").isNotNull() & F.col("last_word_id").isNotNull() & (F.col("first_word_id") <= F.col("last_word_id")))
    ids = some.withColumn("word_id", F.explode(F.sequence("first_word_id", "last_word_id"))).drop("first_word_id", "last_word_id")
    return words.join(ids, [*by, "word_id"])


def context(words: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """(keys, word, context): for each position the words around it, in order, within its keys."""
    around = Window.partitionBy(*keys).orderBy("word").rowsBetween(-before, after)
    return words.select(*keys, "word", F.collect_list("text").over(around).alias("context"))


def skipped(heard: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, gap): positions that follow the one before them with `gap` positions left out. heard: keys, word."""
    prev = F.lag("word").over(Window.partitionBy(*keys).orderBy("word"))
    return heard.select(*keys, "word", (F.col("word") - prev - 1).alias("gap")).where("gap > 0")
