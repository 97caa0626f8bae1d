"""A training corpus from raw documents: stages that each read what the one before wrote.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
columns are there beside doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, ngram_join, packing, quality_model, substring_dedup
from corpusloom.llm.common import cut
from corpusloom.llm.queries import DOMAINS, domains_of, fold, pieces_digest, table, tokenizer
from corpusloom.sources.readers import spread

#: The pipeline keeps what clean text has, and nearly nothing of toxic text.
FACTORS = {"toxic": 0.02}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. A null text is scored like an empty one, equal rows get one verdict, and
    an empty table stays empty."""
    return quality_model.accepted(spread(docs), table(spark, sf_dir, "labels"), fold("id", 3) != 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are similar by 0.8 or more, the smallest doc_id of each component stays. Documents
    without words and rows without a doc_id stay; of equal rows one does."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller document has go; so do documents of which nothing is left. Documents that were
    empty or null before stay; n_chars follows the text."""
    return substring_dedup.without_repeats(docs, length=50)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says: the floor, and one more by a hash of its id. Texts without words are rated like
    any other; without labels every rate is 1."""
    goal = mixing.factors_of(FACTORS, DOMAINS)
    return mixing.mixed(docs, domains_of(table(spark, sf_dir, "labels")), DOMAINS, goal)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens. Each row is packed, repeated ones too; a null text is an empty one,
    which is one piece of the end token."""
    return pieces_digest(packing.pack(docs, tokenizer(), capacity=1024, end_id=0))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: A factorisation machine and a suffix array aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
