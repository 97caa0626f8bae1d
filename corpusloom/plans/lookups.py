"""Registered queries over the nine tables, built by `build.build` from the test tables, and over the nineteen lookups.

Stand-ins: a document is a chapter, 25 of its tokens are a verse, ten are a page line and fifteen lines a page. Letters become Arabic
ones, so digits are verse markers. Each character that isn't a blank makes one phoneme; every seventh verse has no phonetization,
and half of those have spare phonemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import align, corpus
from corpusloom.operators.lookup import Corpus
from corpusloom.plans import build
from corpusloom.plans.catalog import ARABIC, LATIN, TRANSLATED, WORDS, query, read, words

VERSE, LINE, PAGE = 25, 10, 15

BASE = f"""
    w as (select doc_id, word, {TRANSLATED} as text from ({WORDS})),
    words as (select doc_id::integer as surah, ((word - 1) // {VERSE} + 1)::integer as ayah, ((word - 1) % {VERSE} + 1)::integer as word, doc_id * 100000 + word as word_id, text,
              not regexp_full_match(text, '[\\x{{0660}}-\\x{{0669}}]+') as plain, case when (doc_id * 100000 + word) % 3 <> 0 then 'g' || (doc_id * 100000 + word) % 100 end as glyph_text from w),
    verses as (select surah, ayah, coalesce(string_agg(text, ' ' order by word) filter (plain), '') as text from words group by 1, 2),
    ayahs as (select surah, ayah, text, ayah % 7 <> 0 and text <> '' as heard, case when ayah % 7 <> 0 and text <> '' then text when ayah % 14 = 0 then 'ab ' || surah end as phonemes from verses),
    pages as (select (doc_id * 1000 + (word - 1) // {LINE * PAGE})::bigint as page_number, ((word - 1) // {LINE} % {PAGE} + 1)::integer as line_number, 'ayah' as line_type,
              0 as is_centered, min(doc_id * 100000 + word) as first_word_id, max(doc_id * 100000 + word) as last_word_id, null::integer as surah_number from w group by 1, 2
              union all select doc_id * 1000, 0, 'surah_name', 1, null, null, doc_id::integer from documents),
    surahs as (select doc_id::integer as id, coalesce(lang, '') as name_arabic, source as name_simple, 'D' || doc_id as name_english,
               ceil(len(regexp_extract_all(text, '[^\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+')) / {VERSE})::integer as verses_count, null as revelation_place, (doc_id % 9 <> 0)::integer as bismillah_pre from documents),
    ligatures as (select 'surah-' || n_nationkey as key, n_name as glyph from nation),
    imlai_words as (select surah, ayah, word, text, regexp_replace(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\x{{064B}}-\\x{{065F}}\\x{{06D6}}-\\x{{06DC}}]', '', 'g') as normalized_text from words where plain),
    word_map as (select surah, ayah, unnest(range(1, n + 1))::integer as phoneme_word, unnest(range(1, n + 1))::integer as text_word from (select surah, ayah, len(string_split(phonemes, ' ')) as n from ayahs where phonemes is not null)),
    groups as (select surah, ayah, unnest(t) as group_text, unnest(range(0, len(t)))::integer as group_idx from (select surah, ayah, string_split(text, ' ') as t from ayahs where heard)),
    phoneme_groups as (select surah, ayah, group_idx, group_text, (sum(length(group_text) + 1) over (partition by surah, ayah order by group_idx) - length(group_text) - 1)::integer as ph_start,
                       (sum(length(group_text) + 1) over (partition by surah, ayah order by group_idx) - 1)::integer as ph_end, group_idx + 1 as uthmani_word from groups),
    chars as (select surah, ayah, unnest(t) as ch, unnest(range(0, len(t)))::integer as uthmani_idx from (select surah, ayah, string_split(text, '') as t from ayahs where heard)),
    phoneme_char_map as (select surah, ayah, uthmani_idx, uthmani_idx + (ch = ' ')::integer as ph_start, (uthmani_idx + 1 + (ch <> ' ' and coalesce(lead(ch) over v, '') = ' ')::integer)::integer as ph_end,
                         (ch = ' ')::integer as deleted, (case when ch = ' ' then 0 else 1 + sum((ch = ' ')::integer) over (v rows unbounded preceding) end)::integer as uthmani_word from chars window v as (partition by surah, ayah order by uthmani_idx))
"""


def given(spark: SparkSession, d: str) -> build.Inputs:
    docs = read(spark, d, "documents")
    place = F.col("word") - 1
    div = lambda a, n: F.call_function("div", a, F.lit(n)).cast("int")
    w = words(spark, d).select(
        F.col("doc_id").cast("int").alias("surah"), (div(place, VERSE) + 1).alias("ayah"), (place % VERSE + 1).cast("int").alias("word"),
        (F.col("doc_id") * 100000 + F.col("word")).alias("word_id"), F.translate("text", LATIN, ARABIC).alias("text"),
    )
    glyphs = w.where("word_id % 3 <> 0").select("word_id", F.concat(F.lit("g"), F.col("word_id") % 100).alias("glyph_text"), F.lit(1).alias("seq"))
    verses = corpus.verse_texts(w, build.KEYS)
    heard = verses.where("ayah % 7 <> 0").select(*build.KEYS, F.col("text").alias("uthmani"), F.replace("text", F.lit(" "), F.lit("")).alias("raw"))
    heard = align.fixed(heard, "at", align.word_index(F.col("uthmani")))
    rank = lambda w, i: i + 1 - F.when(w > 0, w).otherwise(F.get("at", i - 1))  # noqa: E731  a blank takes the next one's
    mapping = lambda w, i: F.struct(rank(w, i).alias("start"), (rank(w, i) + (w > 0).cast("int")).alias("end"), (w == 0).alias("deleted"))
    heard = align.fixed(heard, "mappings", F.transform("at", mapping)).drop("at")
    lines = words(spark, d).groupBy((F.col("doc_id") * 1000 + div(place, LINE * PAGE)).alias("page_number"), (div(place, LINE) % PAGE + 1).alias("line_number"))
    lines = lines.agg(F.lit("ayah").alias("line_type"), F.lit(0).alias("is_centered"), F.min(F.col("doc_id") * 100000 + F.col("word")).alias("first_word_id"), F.max(F.col("doc_id") * 100000 + F.col("word")).alias("last_word_id"), F.lit(None).cast("int").alias("surah_number"))
    heads = docs.select((F.col("doc_id") * 1000).alias("page_number"), F.lit(0).alias("line_number"), F.lit("surah_name").alias("line_type"), F.lit(1).alias("is_centered"), F.lit(None).cast("long").alias("first_word_id"), F.lit(None).cast("long").alias("last_word_id"), F.col("doc_id").cast("int").alias("surah_number"))
    surahs = docs.select(
        F.col("doc_id").cast("int").alias("id"), F.coalesce("lang", F.lit("")).alias("name_arabic"), F.col("source").alias("name_simple"), F.concat(F.lit("D"), "doc_id").alias("name_english"),
        F.ceil(F.size(T.tokens(F.col("text"))) / VERSE).cast("int").alias("verses_count"), F.lit(None).cast("string").alias("revelation_place"), (F.col("doc_id") % 9 != 0).cast("int").alias("bismillah_pre"),
    )
    return build.Inputs(
        words=w, glyphs=glyphs, plain=w.select(*build.KEYS, "word", "text", F.col("word").alias("seq")), phonetized=heard,
        spare=w.where("ayah % 14 = 0").select(*build.KEYS).distinct().withColumn("phonemes", F.concat(F.lit("ab "), "surah")),
        surahs=surahs, ligatures=read(spark, d, "nation").select(F.concat(F.lit("surah-"), "n_nationkey").alias("key"), F.col("n_name").alias("glyph")), pages=lines.unionByName(heads),
    )


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return build.build(given(spark, d))


PAGES = "page_number, line_number, line_type, is_centered, coalesce(first_word_id, -1) as first_word_id, coalesce(last_word_id, -1) as last_word_id, coalesce(surah_number, -1) as surah_number"


def shown(df: DataFrame) -> DataFrame:
    """Missing numbers as -1, so that engines that show them in different ways can be compared."""
    return df.fillna(-1)


def table_query(name: str, columns: str) -> None:
    def run(spark, d):
        return shown(tables(spark, d)[name])

    run.__name__ = f"table_{name}"
    query(f"with {BASE} select {columns} from {name}")(run)


for _name, _columns in {
    "surahs": "*", "ligatures": "*", "ayahs": "surah, ayah, text, phonemes", "words": "surah, ayah, word, word_id, text, glyph_text", "word_map": "*",
    "phoneme_groups": "*", "phoneme_char_map": "*", "pages": PAGES, "imlai_words": "*",
}.items():
    table_query(_name, _columns)


@query(f"""with {BASE} select unnest(['surahs', 'ligatures', 'ayahs', 'ayahs with phonemes', 'words', 'word_map', 'phoneme_groups', 'phoneme_char_map', 'pages', 'distinct pages', 'imlai_words']) as name,
    unnest([(select count(*) from surahs), (select count(*) from ligatures), (select count(*) from ayahs), (select count(phonemes) from ayahs), (select count(*) from words), (select count(*) from word_map),
    (select count(*) from phoneme_groups), (select count(*) from phoneme_char_map), (select count(*) from pages), (select count(distinct page_number) from pages), (select count(*) from imlai_words)]) as n""")
def build_statistics(spark, d):
    return build.statistics_of(given(spark, d))


@query(f"""with {BASE} select count(*) as verses, count(*) filter (heard) as generated, count(*) filter (not heard and phonemes is not null) as fallback, count(*) filter (phonemes is null) as missing,
    (select count(*) from imlai_words) as imported, (select count(*) from words where not plain) as skipped from ayahs""")
def build_counters(spark, d):
    return build.counters(given(spark, d))


SURAH, AYAH = 7, 2
#: name: the lookup, and the SQL that gives the same rows.
LOOKUPS = {
    "phonemes": (lambda c: c.phonemes(SURAH, AYAH), f"select phonemes from ayahs where surah = {SURAH} and ayah = {AYAH}"),
    "has_ayah": (lambda c: c.has_ayah(SURAH, 5000), f"select count(*) > 0 as found from ayahs where surah = {SURAH} and ayah = 5000"),
    "all_positions": (lambda c: c.all_positions(), "select surah, ayah from ayahs"),
    "words": (lambda c: c.words(SURAH, AYAH), f"select word, text from words where surah = {SURAH} and ayah = {AYAH}"),
    "word_map": (lambda c: c.word_map(SURAH, AYAH), f"select phoneme_word, min(text_word) as text_word from word_map where surah = {SURAH} and ayah = {AYAH} group by 1"),
    "lines_for_page": (lambda c: c.lines_for_page(SURAH * 1000), f"select {PAGES} from pages where page_number = {SURAH * 1000}"),
    "words_for_range": (lambda c: c.words_for_range(700003, 900011), "select surah, ayah, word, word_id, text, glyph_text from words where word_id between 700003 and 900011"),
    "surah_name": (lambda c: c.surah_name(SURAH), f"select name_simple from surahs where id = {SURAH}"),
    "surah_glyph_name": (lambda c: c.surah_glyph_name(SURAH), f"select glyph from ligatures where key = 'surah-{SURAH}'"),
    "ligature": (lambda c: c.ligature("surah-11"), "select glyph from ligatures where key = 'surah-11'"),
    "total_pages": (lambda c: c.total_pages(), "select count(distinct page_number) as pages from pages"),
    "first_position_on_page": (lambda c: c.first_position_on_page(SURAH * 1000), f"select surah, ayah from words where word_id = (select min(first_word_id) from pages where page_number = {SURAH * 1000})"),
    "page_for_position": (lambda c: c.page_for_position(SURAH, AYAH), f"select min(page_number) as page_number from pages p join words w on w.word_id between p.first_word_id and p.last_word_id where w.surah = {SURAH} and w.ayah = {AYAH}"),
    "verses_count": (lambda c: c.verses_count(SURAH), f"select verses_count from surahs where id = {SURAH}"),
    "has_bismillah": (lambda c: c.has_bismillah(9), "select bismillah_pre = 1 as found from surahs where id = 9"),
    "ayahs": (lambda c: c.ayahs((SURAH, 2), (9, 1)), f"select surah, ayah, text from ayahs where (surah > {SURAH} or (surah = {SURAH} and ayah >= 2)) and (surah < 9 or (surah = 9 and ayah <= 1))"),
    "imlai_words": (lambda c: c.imlai_words(SURAH, AYAH), f"select word, text, normalized_text from imlai_words where surah = {SURAH} and ayah = {AYAH}"),
    "imlai_normalized": (lambda c: c.imlai_normalized(SURAH, AYAH, 3), f"select normalized_text from imlai_words where surah = {SURAH} and ayah = {AYAH} and word = 3"),
    "imlai_word_count": (lambda c: c.imlai_word_count(SURAH, AYAH), f"select count(*) as n from imlai_words where surah = {SURAH} and ayah = {AYAH}"),
}


def lookup_query(name: str) -> None:
    lookup, sql = LOOKUPS[name]

    def run(spark, d):
        return shown(lookup(Corpus(tables(spark, d))))

    run.__name__ = f"lookup_{name}"
    query(f"with {BASE} {sql}")(run)


for _name in LOOKUPS:
    lookup_query(_name)
