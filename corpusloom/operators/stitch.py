"""Segments of a group joined into one text, and equal texts of several sources into one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens


def stitch(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments: keys, w_start, w_end, phonemes, match_ratio, reciter, seq. By word_start and seq, what earlier segments
    cover is cut off a later one: word by word where words and tokens agree, else in proportion. A group of one segment
    keeps its text as it is. Mean match_ratio is over all segments, the reciter is the first's."""
    w = Window.partitionBy(*keys).orderBy("w_start", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("cov", F.greatest(F.lit(0), F.coalesce(F.max("w_end").over(before), F.lit(0))))
    rows = rows.withColumn("t", tokens(F.col("phonemes")))
    n, span, over = F.size("t"), F.col("w_end") - F.col("w_start"), F.greatest(F.col("cov") - F.col("w_start"), F.lit(0))
    skip = F.when(over == 0, 0).when(n == span, over).otherwise(F.call_function("div", over * n, span)).cast("int")
    rest = F.slice("t", F.greatest(skip, F.lit(0)) + 1, F.greatest(n, F.lit(1)))
    rows = rows.withColumn("part", F.when(F.col("w_end") > F.col("cov"), rest))
    pick = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("w_start", "seq", "part"))))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.avg("match_ratio").alias("match_ratio"), F.min_by("reciter", F.struct("w_start", "seq")).alias("reciter"),
        F.min("seq").alias("first_seq"), F.first("phonemes").alias("only"), pick.alias("parts"),
    )
    joined = F.array_join(F.flatten(F.transform("parts", lambda p: p["part"])), " ")
    return out.select(*keys, "n_segments", "match_ratio", "reciter", "first_seq", F.when(F.col("n_segments") == 1, F.col("only")).otherwise(joined).alias("phonemes"))


def variants(texts: DataFrame, keys: list[str], source: str, prefix: str = "moshaf_", first: str | None = None) -> DataFrame:
    """Equal rows of several sources as one, with the sorted sources (the prefix taken out); `first` names a column for the
    smallest source as it was."""
    names = F.sort_array(F.collect_set(F.replace(F.col(source), F.lit(prefix), F.lit(""))))
    more = [F.min(source).alias(first)] if first else []
    return texts.groupBy(*keys).agg(names.alias("configs"), *more)
