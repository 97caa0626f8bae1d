"""Quality rules by distribution divergence. DataFrame functions only.

Each document's histogram of character classes (capitals, digits, blanks, symbols, other ASCII marks, the rest) and its histogram of common words are compared with those of
its language by Jensen-Shannon distance (base 2, so 0 to 1). A language's reference is the mean of its
documents' histograms over the whole corpus. Base rules on length and repetition come first.

Defined cases: a null text is an empty one; empty and very short texts fail the base rules; a null language, or one that isn't
among the LANGUAGES with the most documents, is compared with the reference of all documents of such a histogram; where a reference has next to no common words, their absence
says nothing and only MAX_WORD_DISTANCE holds; texts under the minimum lengths skip the
comparison that would be noise; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, cut

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Very common words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "with", "on", "was", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con"],
}
ALL_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Languages that have a reference of their own: those with the most documents.
LANGUAGES = 1000
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.34
MAX_WORD_DISTANCE = 0.50
#: A text may come as near as this share to the distance of a text without any common word.
WITHOUT_WORDS = 0.9
#: Least share of common words in a reference for that.
LEAST_COMMON = 0.05


def words_of(text: Column) -> Column:
    """Words as an array; none for an empty or blank text. One kind of blank lets the split go without a pattern."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    body = F.btrim(text)
    return F.when(body == "", F.array().cast("array<string>")).when(F.contains(body, F.lit("  ")), F.split(body, " +")).otherwise(F.split(body, " "))


def base_features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One pass over the texts, without a shuffle: counts, both histograms, the language."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"), body.alias("body"))
    rows = rows.select(
        "doc_id", "lang", "body",
        words_of(F.col("body")).alias("w"),
        F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.regexp_replace("body", "[a-z ]+", "").alias("few"),
    )
    rows = rows.select(
        "doc_id", "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("few", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("x1"),
        F.filter("w", lambda x: x.isin(*ALL_WORDS)).alias("listed"),
        F.length("body").cast("long").alias("n_all"),
        F.length(F.regexp_replace("few", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("few", "[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("few", "[^!-/:-@\\[-`{-~]+", "")).cast("long").alias("n_ascii_marks"),
    )
    # Hashes of 2, 3 and 5 words from each place on; each step is a column of its own, so none is computed twice.
    rest = [c for c in rows.columns if c != "x1"]

    def joined(left: str, right: str, by: int) -> Column:
        return F.zip_with(left, F.slice(right, by + 1, F.greatest(F.size(right), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    rows = rows.select(*rest, "x1", joined("x1", "x1", 1).alias("x2"))
    rows = rows.select(*rest, joined("x2", "x2", 1).alias("x3"))
    rows = rows.select(*rest, F.slice(joined("x3", "x3", 2), 1, F.greatest(F.size("x3") - (WINDOW - 1), F.lit(0))).alias("h"))
    # Only texts in which a window returns need the sort that finds the words it covers.
    again = F.size(F.array_distinct("h")) < F.size("h")
    order = F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.withColumn("s", order)
    last = F.size("s") - 1
    same = lambda x, i: ((i > 0) & (F.get(F.col("s"), i - 1)["x"] == x["x"])) | ((i < last) & (F.get(F.col("s"), i + 1)["x"] == x["x"]))
    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])))
    covered = F.aggregate(
        F.col("at"), F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(p - acc["p"], F.lit(WINDOW))).alias("n")),
    )["n"]
    spaces = F.col("n_all") - F.col("word_chars")
    marks = F.greatest(F.col("n_ascii_marks") - F.col("n_symbols"), F.lit(0))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[x.cast("double") for x in (F.col("n_upper"), F.col("n_digits"), spaces, F.col("n_symbols"), marks, F.greatest(F.col("n_all") - F.col("n_upper") - F.col("n_digits") - spaces - F.col("n_ascii_marks"), F.lit(0)))]).alias("chars"),
        word_histogram(F.col("listed"), F.col("n_words"), F.col("lang")).alias("common"),
    )


def word_histogram(listed: Column, n: Column, lang: Column) -> Column:
    """Counts of the language's common words and, last, of all other words."""

    def count(word: str) -> Column:
        return F.size(F.filter(listed, lambda x: x == F.lit(word))).cast("double")

    def counts(words: list[str]) -> Column:
        each = F.array(*[count(w) for w in words])
        return F.transform(F.array(each), lambda a: F.concat(a, F.array(n.cast("double") - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))[0]

    out = None
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, counts(words)) if out is None else out.when(lang == name, counts(words))
    # another language: the share of any listed word
    return out.otherwise(F.array(F.size(listed).cast("double"), n.cast("double") - F.size(listed)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(total), lambda t: F.when(t > 0, F.transform(counts, lambda x: x / t)))[0]


def references(features: DataFrame) -> dict[str, dict[tuple[str, int], list[float]]]:
    """By kind of histogram and (language, width) the mean histogram; '' for all languages of that width. Bounded: LANGUAGES languages."""
    some = features.where(F.col("n_words") > 0)
    named_ones = some.where(F.col("lang").isNotNull())
    known = [r["lang"] for r in named_ones.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    label = F.when(F.col("lang").isin(*known), F.col("lang")) if known else F.lit(None).cast("string")
    out: dict = {}
    for kind in ("chars", "common"):
        parts = some.select(label.alias("lang"), F.posexplode(shares(F.col(kind))).alias("k", "x"), F.size(kind).alias("width"))
        found: dict = {}
        for r in parts.groupBy("lang", "width", "k").agg(F.sum("x").alias("x"), F.count("x").alias("n")).collect():  # LANGUAGES histograms
            for name in {r["lang"], ""} - {None}:
                x, n = found.setdefault((name, r["width"]), {}).get(r["k"], (0.0, 0))
                found[name, r["width"]][r["k"]] = (x + r["x"], n + r["n"])
        out[kind] = {at: [by[k][0] / by[k][1] for k in range(at[1])] for at, by in found.items() if len(by) == at[1]}
    return out


def reference_table(spark: SparkSession, refs: dict) -> DataFrame:
    """(ref_lang, ref_kind, ref_width, ref, ref_limit): the references as a table of a few numbers a language."""
    rows = [(name, kind, width, q, word_limit(q) if kind == "common" else MAX_CHAR_DISTANCE) for kind, own in refs.items() for (name, width), q in sorted(own.items())]
    return spark.createDataFrame(rows, "ref_lang string, ref_kind string, ref_width int, ref array<double>, ref_limit double")


def word_limit(reference: list[float]) -> float:
    """The largest word distance that a kept text may have: below that of a text without any common word."""
    rest = reference[-1]
    if rest > 1 - LEAST_COMMON:
        return MAX_WORD_DISTANCE
    # all words are other ones: (log2(2 / (1 + rest)) + rest * log2(2 * rest / (1 + rest)) + the reference's common words) / 2
    half = math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest > 0 else 0.0) + (1 - rest)
    return min(MAX_WORD_DISTANCE, WITHOUT_WORDS * math.sqrt(max(half / 2, 0.0)))


def distance(counts: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of a histogram to a reference; 0 without one."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(shares(counts), ref, lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.coalesce(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))), F.lit(0.0))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance)."""
    rows = cut(base_features(docs, key, text, lang))
    table = reference_table(docs.sparkSession, references(rows))
    for kind in ("chars", "common"):
        own = table.where((F.col("ref_kind") == kind) & (F.col("ref_lang") != "")).select("ref_lang", F.col("ref_width").alias(f"{kind}_width"), F.col("ref").alias(f"{kind}_own"), F.col("ref_limit").alias(f"{kind}_own_limit"))
        rest = table.where((F.col("ref_kind") == kind) & (F.col("ref_lang") == "")).select(F.col("ref_width").alias(f"{kind}_width"), F.col("ref").alias(f"{kind}_any"), F.col("ref_limit").alias(f"{kind}_any_limit"))
        rows = with_reference(rows, own, rest, kind)
    total = F.aggregate("chars", F.lit(0.0), lambda s, x: s + x)
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.when(total >= MIN_CHARS, distance(F.col("chars"), F.col("chars_ref"))).alias("char_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("common"), F.col("common_ref"))).alias("word_distance"),
        F.coalesce("common_limit", F.lit(MAX_WORD_DISTANCE)).alias("word_limit"),
    )
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= F.col("word_limit"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "char_distance", "word_distance")


def with_reference(rows: DataFrame, own: DataFrame, rest: DataFrame, kind: str) -> DataFrame:
    """Adds <kind>_ref and <kind>_limit: of the language, else of all documents with a histogram of that width."""
    rows = rows.withColumn(f"{kind}_width", F.size(kind))
    rows = rows.join(F.broadcast(own.withColumnRenamed("ref_lang", "lang")), ["lang", f"{kind}_width"], "left").join(F.broadcast(rest), f"{kind}_width", "left")
    return rows.withColumns({f"{kind}_ref": F.coalesce(f"{kind}_own", f"{kind}_any"), f"{kind}_limit": F.coalesce(f"{kind}_own_limit", f"{kind}_any_limit")})
