"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one block of documents holds at least. Blocks bound what a task keeps in memory; their number follows the input.
BLOCK_BYTES = 8 << 20
#: Blocks from which on they grow with the input instead of in number, as far as memory allows: each block sends something to most
#: of as many buckets, so many small blocks would send many tiny messages.
MANY_BLOCKS = 4096
#: Bytes of a task's memory that a byte of its block may take.
TIMES_BLOCK = 24
#: Fewest blocks, so that a small input still uses every core and no block stands out.
LEAST_BLOCKS = 64
#: What separates words, in every operator of this subpackage that speaks of words.
SPACES = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame) -> list[Column]:
    """df's columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local session."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: it survives a lost executor and isn't computed again.
    The files go when the session ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def task_memory(spark: SparkSession) -> int:
    """Bytes of an executor's memory for each of its cores, by the session's settings."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[")
    size = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    memory = int(size[:-1]) * units[size[-1]] if size[-1] in units else int(size)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "4"))
    return memory // max(1, cores)


def block_bytes(total: int, memory: int) -> int:
    """Text a block: BLOCK_BYTES, and more for an input of over MANY_BLOCKS of them, up to what a task's memory holds."""
    return max(BLOCK_BYTES, min(-(-total // MANY_BLOCKS), memory // TIMES_BLOCK))


def block_count(docs: DataFrame, text: str = "text") -> int:
    """Blocks of documents for an input of this size."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-total // block_bytes(total, task_memory(docs.sparkSession))))


def block_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def taught_rows(docs: DataFrame, labels: DataFrame, marks: list[str], key: str, text: str, most_rows: int, salt: int) -> DataFrame:
    """(id, text, marks): the drawn rows of labels (id, marks) with their document's text; at most most_rows, whatever repeats.

    Rows of labels are drawn by a hash of the id, ties by what they hold, so the same tables give the same sample however they
    are dealt. Of rows of docs with one id, the one whose text has the smallest hash teaches."""
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(salt)), F.lit(1 << 30))
    known = cut(labels.select("id", *marks, draw.alias("draw")).orderBy("draw", "id", *marks).limit(most_rows).select("id", *marks))
    ids = F.broadcast(known.select("id").distinct())  # most_rows ids at most
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id")
    single = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    return single.join(F.broadcast(known), "id").select("id", "text", *marks)


def give_back() -> None:
    """Memory that this process holds and doesn't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, for a Python worker, which gives back what it no longer uses after each group, or at the end of an iterator of batches.
    Workers outlive their stages; else each would keep the most that it ever held, beside those of the next stages."""
    if inspect.isgeneratorfunction(run):

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)
            give_back()

        return over

    def freed(*group):
        out = run(*group)
        give_back()
        return out

    # Spark tells groups from pairs of groups by the arguments' number
    return (lambda key, left, right: freed(key, left, right)) if len(inspect.signature(run).parameters) == 3 else (lambda key, table: freed(key, table))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type) for f, v in zip(schema, (columns[f.name] for f in schema))], schema=schema)


def per_text(df: DataFrame, keep: list[str], text: str, schema: str, make: Callable[[], Callable[[list], Iterable[tuple]]]) -> DataFrame:
    """Adds columns that depend on one text each; make() runs once a task and returns a function from texts to rows of `schema`.

    keep: columns of df that stay. A null text comes as None."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    own = dict(zip(df.columns, named(df)))
    kept = [own[c] for c in keep]
    base = df.select(*[c.alias(f"c{k}") for k, c in enumerate(kept)], F.col(text).alias("text_in"))  # plain names on the way to Python
    out = StructType([*df.select(*kept).schema.fields, *added.fields])
    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, score = to_arrow_schema(out), make()
        for b in batches:
            rows = list(score(b.column(b.num_columns - 1).to_pylist()))
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            columns += [pa.array([r[k] for r in rows], arrow.field(len(keep) + k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return base.mapInArrow(tidy(run), out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
