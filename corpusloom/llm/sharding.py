"""Sharding by a Feistel permutation with cycle walking. DataFrame functions only.

Rows get global numbers 0..N-1 in order of (doc_id, size, checksum), nulls first. A keyed Feistel network
over a grid just larger than N, walked until it falls below N, permutes the numbers. Permuted number p goes
to shard p mod S, slot p div S, so counts differ by one at most, slots have no gaps, and shard and slot can
be computed for any row number without looking at data.

Defined cases: a null text has no bytes and checksum 0; null doc_ids come first; rows equal in all three
keys are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, fresh

#: A prime below 2^31: squares of residues stay inside a long.
PRIME = 2147483647
ROUNDS = 4
OVERHEAD = 16


def sides(n: int) -> tuple[int, int]:
    """The grid of the network: a * b >= n, and less than a cells over."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    return [((seed * 48271 + 69621 * (k + 1)) % (PRIME - 2) + 1, (seed * 16807 + 40692 * (k + 3)) % PRIME) for k in range(ROUNDS)]


def mixed(right: Column, key: tuple[int, int]) -> Column:
    z = F.pmod(F.pmod(right, F.lit(PRIME)) * F.lit(key[0]) + F.lit(key[1]), F.lit(PRIME))
    return F.pmod(z * z + z * F.lit(3) + right, F.lit(PRIME))


def round_of(k: int, key: tuple[int, int], a: int, b: int) -> Callable[[Column], Column]:
    if k % 2:
        return lambda s: F.struct(F.pmod(s["l"] + mixed(s["r"], key), F.lit(a)).alias("l"), s["r"].alias("r"))
    return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + mixed(s["l"], key), F.lit(b)).alias("r"))


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass over the cells of an a by b grid. In even rounds the column number moves, in odd ones the row's."""
    state = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    for k, key in enumerate(round_keys(seed)):
        state = F.transform(F.array(state), round_of(k, key, a, b))[0]
    return F.transform(F.array(state), lambda s: s["l"] * F.lit(b) + s["r"])[0]


def permuted(df: DataFrame, number: str, n: int, seed: int, out: str) -> DataFrame:
    """Adds column `out`: the place of row `number` (0..n-1) in the shuffle.

    a*b-n cells of the grid lie above n, so a walk ends after at most that many more passes; a row
    needs one with probability below 1/sqrt(n)."""
    a, b = sides(n)
    df = df.withColumn(out, feistel(F.col(number), a, b, seed))
    if over := a * b - n:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(over)), F.col(out), lambda at, _: F.when(at < F.lit(n), at).otherwise(feistel(at, a, b, seed)))
        df = df.withColumn(out, F.when(F.col(out) < F.lit(n), F.col(out)).otherwise(walk))
    return df


def numbered(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """Adds the global row number 0..N-1 in the given order, without bringing the rows to one task.

    Rows are sorted over range partitions and counted; what the driver gets is one count a partition."""
    mark = fresh(df, "mark")
    ordered = cut(df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).withColumn(mark, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mark), 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    first, offset = fresh(ordered, "first_part"), fresh(ordered, "first_row")
    offsets = df.sparkSession.createDataFrame(starts, f"{first} long, {offset} long")
    joined = ordered.join(F.broadcast(offsets), part == F.col(first))
    return joined.withColumn(out, F.col(offset) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).drop(mark, first, offset), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard) for every row of docs."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"], "row_number")
    placed = permuted(rows, "row_number", n, seed, "place")
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number", F.lit("rows").alias("law"),
        F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
