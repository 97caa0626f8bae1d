"""Recorded segments to one list of each verse's phonemes, with the sources that agree on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import stitch
from corpusloom.sources import sinks


def chosen(configs: DataFrame, names: str = "all", first: int = 0) -> DataFrame:
    """Of (config), sorted: all of them, else the first few, else those of a list parted by commas."""
    known = configs.where("config <> ''").distinct()
    if names == "all":
        return known.orderBy("config")
    if first > 0:
        return known.orderBy("config").limit(first)
    return known.where(F.col("config").isin([c.strip() for c in names.split(",")])).orderBy("config")


def segments(rows: DataFrame) -> DataFrame:
    """rows: has_quran, start_span and end_span (structs of sura_idx, aya_idx, imlaey), phonemes, match_ratio,
    reciter_english_name, config, seq. Rows that are known to hold no verse, or miss a span or phonemes, go."""
    fits = F.coalesce("has_quran", F.lit(False)) & F.col("start_span").isNotNull() & F.col("end_span").isNotNull() & (F.length("phonemes") > 0)
    return rows.where(fits).select(
        F.col("start_span.sura_idx").cast("int").alias("surah"), F.col("start_span.aya_idx").cast("int").alias("ayah_start"), F.col("end_span.aya_idx").cast("int").alias("ayah_end"),
        F.col("start_span.imlaey").cast("int").alias("w_start"), F.col("end_span.imlaey").cast("int").alias("w_end"), "phonemes",
        F.col("match_ratio").cast("double").alias("match_ratio"), F.col("reciter_english_name").alias("reciter"), "config", "seq",
    )


def verses(found: DataFrame) -> DataFrame:
    """Segments of one verse stitched: (config, surah, ayah_start, n_segments, match_ratio, reciter, first_seq, phonemes)."""
    return stitch.stitch(found.where("ayah_start = ayah_end"), ["config", "surah", "ayah_start"])


def agreed(stitched: DataFrame) -> DataFrame:
    """(surah, ayah_start, ayah_end, phonemes, configs, first_config): equal phonemes of a verse as one row."""
    rows = stitched.withColumn("ayah_end", F.col("ayah_start"))
    keys = ["surah", "ayah_start", "ayah_end", "phonemes"]
    return stitch.variants(rows, keys, "config", first="first_config")


def extract(rows: DataFrame) -> DataFrame:
    """(value): the compact JSON rows, by verse and, within one, by the first source."""
    out = agreed(verses(segments(rows))).orderBy("surah", "ayah_start", "ayah_end", "first_config")
    return sinks.json_rows(out, ["surah", "ayah_start", "ayah_end", "phonemes", "configs"])


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, skipped, n_segments, n_verses, n_unique."""
    kept = segments(rows)
    stitched = verses(kept)
    one = rows.agg(F.count("*").alias("total"))
    for name, df in (("n_segments", kept), ("n_verses", stitched), ("n_unique", agreed(stitched))):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))  # single rows
    return one.select("total", (F.col("total") - F.col("n_segments")).alias("skipped"), "n_segments", "n_verses", "n_unique")


def variants(wanted: DataFrame, there: DataFrame, only: str | None = None) -> DataFrame:
    """(variant) of those wanted that are there; only: the one of that name, whatever the case."""
    some = wanted if only is None else wanted.where(F.upper("variant") == only.upper())
    return some.join(there.select("variant").distinct(), "variant", "left_semi")


def against_baseline(sizes: DataFrame) -> DataFrame:
    """(seq, variant, size, percent): how much smaller each variant is than the first one by seq, in percent."""
    base = sizes.agg(F.min_by("size", "seq")).scalar()
    return sizes.select("seq", "variant", "size", ((1 - F.col("size") / base) * 100).alias("percent"))
