"""The read API over the nine tables: each method gives a DataFrame, so filters reach the files.

Where the meaning is open: a word map's many partners collapse to the smallest word, a chapter's name is its simple
one, and ranges include both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.corpus import word_lines


class Corpus:
    """tables: name to DataFrame, as in sources.schemas.TABLES."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.t = tables

    def _verse(self, table: str, surah: int, ayah: int) -> DataFrame:
        return self.t[table].where((F.col("surah") == surah) & (F.col("ayah") == ayah))

    def phonemes(self, surah: int, ayah: int) -> DataFrame:
        return self._verse("ayahs", surah, ayah).select("phonemes")

    def has_ayah(self, surah: int, ayah: int) -> DataFrame:
        return self._verse("ayahs", surah, ayah).agg((F.count("*") > 0).alias("found"))

    def all_positions(self) -> DataFrame:
        return self.t["ayahs"].select("surah", "ayah").orderBy("surah", "ayah")

    def words(self, surah: int, ayah: int) -> DataFrame:
        return self._verse("words", surah, ayah).select("word", "text").orderBy("word")

    def word_map(self, surah: int, ayah: int) -> DataFrame:
        return self._verse("word_map", surah, ayah).groupBy("phoneme_word").agg(F.min("text_word").alias("text_word"))

    def lines_for_page(self, page: int) -> DataFrame:
        return self.t["pages"].where(F.col("page_number") == page).orderBy("line_number")

    def words_for_range(self, first: int, last: int) -> DataFrame:
        return self.t["words"].where(F.col("word_id").between(first, last)).orderBy("word_id")

    def surah_name(self, surah: int) -> DataFrame:
        return self.t["surahs"].where(F.col("id") == surah).select("name_simple")

    def ligature(self, key: str) -> DataFrame:
        return self.t["ligatures"].where(F.col("key") == key).select("glyph")

    def surah_glyph_name(self, surah: int) -> DataFrame:
        return self.ligature(f"surah-{surah}")

    def total_pages(self) -> DataFrame:
        return self.t["pages"].agg(F.count_distinct("page_number").alias("pages"))

    def first_position_on_page(self, page: int) -> DataFrame:
        first = self.t["pages"].where((F.col("page_number") == page) & F.col("first_word_id").isNotNull()).agg(F.min("first_word_id").alias("word_id"))
        return self.t["words"].join(first, "word_id").select("surah", "ayah")

    def page_for_position(self, surah: int, ayah: int) -> DataFrame:
        words = self._verse("words", surah, ayah).select("word_id")
        least, most = words.select(F.min("word_id")).scalar(), words.select(F.max("word_id")).scalar()
        near = self.t["pages"].where((F.col("first_word_id") <= most) & (F.col("last_word_id") >= least))  # only these lines become a row a word
        return word_lines(near.select("page_number", "first_word_id", "last_word_id"), words, []).agg(F.min("page_number").alias("page_number"))

    def verses_count(self, surah: int) -> DataFrame:
        return self.t["surahs"].where(F.col("id") == surah).select("verses_count")

    def has_bismillah(self, surah: int) -> DataFrame:
        return self.t["surahs"].where(F.col("id") == surah).select((F.col("bismillah_pre") == 1).alias("found"))

    def ayahs(self, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
        at = F.struct("surah", "ayah")
        low, high = (F.struct(F.lit(s).alias("surah"), F.lit(a).alias("ayah")) for s, a in (first, last))
        return self.t["ayahs"].where((at >= low) & (at <= high)).select("surah", "ayah", "text").orderBy("surah", "ayah")

    def imlai_words(self, surah: int, ayah: int) -> DataFrame:
        return self._verse("imlai_words", surah, ayah).select("word", "text", "normalized_text").orderBy("word")

    def imlai_normalized(self, surah: int, ayah: int, word: int) -> DataFrame:
        return self._verse("imlai_words", surah, ayah).where(F.col("word") == word).select("normalized_text")

    def imlai_word_count(self, surah: int, ayah: int) -> DataFrame:
        return self._verse("imlai_words", surah, ayah).agg(F.count("*").alias("n"))
