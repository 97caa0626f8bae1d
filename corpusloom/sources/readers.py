"""Sources. Schemas are always given; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import key_parts

WORD = "struct<id: int, text: string>"
CHAPTER = "struct<id: int, name: string, name_simple: string, name_arabic: string, revelation_place: string, verses_count: int, bismillah_pre: boolean>"


#: Bytes of a table that is dealt anew if it has fewer files than there are cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table just read, dealt over all cores if it lies in fewer files than that: a file of one row group is read by one task, and
    so would be all that follows without a shuffle. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def json_map(docs: DataFrame, column: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """(key, value) for each entry of one JSON object a row, beside the columns to keep."""
    return docs.select(*(keep or []), F.explode(F.from_json(column, f"map<string, {value}>")).alias("key", "value"))


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    return json_map(spark.read.text(path, wholetext=True), "value", value)


def keyed_words(entries: DataFrame) -> DataFrame:
    """(surah, ayah, word, word_id, text) of entries whose key has three parts."""
    fits, (s, a, w) = key_parts(F.col("key"), 3)
    return entries.where(fits).select(s.alias("surah"), a.alias("ayah"), w.alias("word"), F.col("value.id").alias("word_id"), F.coalesce("value.text", F.lit("")).alias("text"))


def flat_map(entries: DataFrame) -> DataFrame:
    """(key, glyph) of a flat map's entries."""
    return entries.select("key", F.col("value").alias("glyph"))


def chapters(entries: DataFrame) -> DataFrame:
    v = F.col("value")
    return entries.select(v["id"].alias("id"), v["name_arabic"].alias("name_arabic"), v["name_simple"].alias("name_simple"), v["name"].alias("name_english"), v["verses_count"].alias("verses_count"), v["revelation_place"].alias("revelation_place"), F.when(F.coalesce(v["bismillah_pre"], F.lit(True)), 1).otherwise(0).alias("bismillah_pre"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where nothing is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def config_of(path: Column) -> Column:
    """The folder that starts with moshaf_ in a Parquet file's path; empty for metadata and other files."""
    return F.when(~F.contains(path, F.lit("metadata")), F.regexp_extract(path, "(moshaf_[^/]*)/(?:[^/]*/)*[^/]*\\.parquet$", 1)).otherwise("")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file under a folder; no file's content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def configs(spark: SparkSession, root: str) -> DataFrame:
    """(config), sorted: the folders under root that hold Parquet files of a config."""
    return files(spark, root).select(config_of(F.col("path")).alias("config")).where("config <> ''").distinct().orderBy("config")


def directory_size(spark: SparkSession, root: str, unit: float = 1e6) -> DataFrame:
    """One row: files, bytes, and bytes in a unit (1e6, or 2^20)."""
    return files(spark, root).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("size", F.col("bytes") / F.lit(float(unit)))


def in_file_order(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Pruned columns with the file and the row within it, which define the order of rows."""
    return spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def seeded_tensor(spark: SparkSession, n: int, width: int, seed: int = 42) -> DataFrame:
    """(row, features, mask): n rows of `width` normal numbers, and a mask of ones. Equal for equal arguments."""
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("row"), *[F.randn(seed + k).cast("float").alias(f"f{k}") for k in range(width)])
    return rows.select("row", F.array(*[f"f{k}" for k in range(width)]).alias("features"), F.lit(1).alias("mask"))


def verses(chapters_: DataFrame) -> DataFrame:
    """(surah, ayah) of every verse: numbers 1 to the chapter's count."""
    some = chapters_.where("verses_count >= 1")
    return some.select(F.col("id").alias("surah"), F.explode(F.sequence(F.lit(1), F.col("verses_count"))).alias("ayah"))
