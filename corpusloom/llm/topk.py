"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks, dimension by dimension (vertical layout). For a query, inner products grow block of
dimensions by block; after each one, a candidate whose partial product plus the most that the remaining
dimensions can add (product of the two remaining norms) stays below the query's k-th best score is dropped,
and the survivors are compacted. The bound is safe, so the result is exact, ties included.

Queries are a stated set; both sides are cut into blocks of bounded size, and a task gets one query block and
one candidate block. Candidate blocks come in waves, each as large as all before it: a wave starts with the k-th best
score that each query has so far, gives only what reaches it, and the rows kept so far and its own leave k a query.

Defined cases: vectors that are null or empty or hold a null or non-finite component take no part; a query isn't a
candidate for itself, nor is any row with its id; rows with equal ids are candidates each; a repeated query id
counts once, with its smallest vector; vectors of other length than the query's are no candidates for it; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import block_of, cut

CANDIDATES = 8192
QUERIES = 4096
#: Queries a block at least, unless there are fewer: few queries are still dealt over the cores.
LEAST_QUERIES = 256
#: Dimensions that are added before survivors are compacted.
STEP = 8


def blocks(vectors: DataFrame, n: int, prefix: str, more: str | None = None) -> DataFrame:
    """(dim, <prefix>, <prefix>_ids, <prefix>_data): one row a block, its matrix dimension by dimension. more: a column of numbers
    that goes along, as <prefix>_more."""
    ddl = f"dim int, {prefix} int, {prefix}_ids binary, {prefix}_data binary" + (f", {prefix}_more binary" if more else "")
    names = [x.split()[0] for x in ddl.split(", ")]

    def lay(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows["vec_id"].to_numpy()
        data = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        blobs = [ids[order].astype("<i8"), np.ascontiguousarray(data[order].T).astype("<i8")]
        blobs += [rows[more].to_numpy()[order].astype("<f8")] if more else []
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=names)

    placed = vectors.select("vec_id", "v", *([more] if more else []), F.size("v").alias("dim"), block_of(n, "vec_id").alias(prefix))
    return placed.groupBy("dim", prefix).applyInArrow(lay, ddl)


def search_block(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best candidates in the block, of those that reach its floor: (query id, candidate ids, scores). c: dimensions x
    candidates, ids rising."""
    dims, n = c.shape
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims < 2**53:
        q, c = q.astype(np.float64), c.astype(np.float64)  # every partial sum is an integer below 2^53: exact
    left = np.sqrt(np.maximum(np.cumsum((c[::-1].astype(np.float64)) ** 2, axis=0)[::-1], 0))  # norms of the dimensions from each on
    seeds = np.arange(0, n, max(1, n // (8 * k)))
    floor = np.full(len(qid), -np.inf) if floor is None else floor
    for i, one, start in zip(qid.tolist(), q, floor.tolist()):
        qleft = np.sqrt(np.cumsum(one[::-1].astype(np.float64) ** 2)[::-1])
        first = one @ c[:, seeds]
        first = first[cid[seeds] != i]
        # the k-th best of a few whole scores is a bound from the start
        least = max(start, np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf)
        alive = np.flatnonzero(cid != i)
        part = np.zeros(len(alive), dtype=c.dtype)
        for d in range(0, dims, STEP):
            part = part + one[d : d + STEP] @ c[d : d + STEP, alive]
            e = d + STEP
            if e < dims:
                most = part + qleft[e] * left[e, alive] * (1 + 1e-9) + 1e-6
                keep = most >= least
                if not keep.all():
                    alive, part = alive[keep], part[keep]
        alive, part = alive[part >= start], part[part >= start]
        order = np.lexsort((cid[alive], -part))[:k]
        yield i, cid[alive[order]], part[order].astype(np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score); the inner products are of floor(scale * component).

    is_query: a Column over vec_id that tells the queries."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(scale))).alias("v"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, nq = rows.select(F.count("*"), F.count_if(is_query)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    nc, nq = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES), min(-(-nq // LEAST_QUERIES), cores))
    candidates = cut(blocks(rows, nc, "c"))
    each = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = {x: np.frombuffer(r[f"{x}_ids"], "<i8") for x in "cq"}
                data = {x: np.frombuffer(r[f"{x}_data"], "<i8").reshape(r["dim"], -1) for x in "cq"}
                out = list(search_block(np.ascontiguousarray(data["q"].T), ids["q"], data["c"], ids["c"], k, np.frombuffer(r["q_more"], "<f8")))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()),
                    pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                    pa.array(np.concatenate([o[2] for o in out]), pa.int64()),
                ], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    best, low = None, 0
    while low < nc:
        high = min(nc, max(1, 2 * low))
        if best is None:
            asked = queries.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
            asked = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        # every query block meets every candidate block of the wave, each pair under a key of its own so that pairs spread over the tasks
        some = candidates.where((F.col("c") >= low) & (F.col("c") < high)).withColumn("q", each(0, nq))
        found = some.join(blocks(asked, nq, "q", "floor").withColumn("c", each(low, high)), ["dim", "q", "c"]).mapInArrow(run, "query_id long, vec_id long, score long")
        found = found if best is None else found.union(best.select("query_id", "vec_id", "score"))
        best = cut(found.withColumn("rank", rank).where(F.col("rank") <= k))
        low = high
    return best.select("query_id", "rank", "vec_id", "score")
