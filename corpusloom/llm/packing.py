"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's tokens (with an end id) give full windows first; what is left is cut into pieces, and the pieces
of a bounded group of documents are spread over k windows: partial partitions with the largest differences
are merged so that their imbalances oppose each other, until one partition with near-equal windows remains.
If a window exceeds the capacity, k rises and the group is packed anew. Groups are consecutive documents of
an input partition, so nothing is shuffled and a task holds one group at a time; a lost task packs its own
partition again and gets the same result.

Defined cases: a null or empty text is one end id; every row is packed, rows with equal or null doc_ids too;
very long texts fill windows as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import tidy
from corpusloom.llm.tokens import SPLIT, byte_letters

#: Pieces that are packed together at most; the cost of a group grows with its square.
GROUP = 640
#: A cut of every FILL-th rest into small pieces lets windows come out near-equal.
FILL = 4
SMALL = 64
#: Blanks in one run that the faster engine is given at most; its pattern fails on a run of about a million.
BLANKS = 100_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def spread(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each size, by largest differencing over k-way partial partitions."""
    n = len(sizes)
    left, right = np.full(2 * n * 2, -1), np.full(2 * n * 2, -1)  # nodes: pieces, then joined windows
    grown = n
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i, np.array([s], dtype=np.int64), np.array([i])))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        # a and b hold their windows in falling order, empty ones left out: the largest meets the smallest.
        if len(a) + len(b) <= k:
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
        else:
            over = len(a) + len(b) - k
            mine, theirs = np.arange(len(a) - over, len(a)), np.arange(len(b) - over, len(b))[::-1]
            if grown + over > len(left):
                left = np.concatenate([left, np.full(len(left) + over, -1)])
                right = np.concatenate([right, np.full(len(right) + over, -1)])
            fresh = np.arange(grown, grown + over)
            left[fresh], right[fresh] = na[mine], nb[theirs]
            grown += over
            sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], a[mine] + b[theirs]])
            nodes = np.concatenate([na[: len(a) - over], nb[: len(b) - over], fresh])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (-int(sums[0] - low), i, sums, nodes))
    out = np.zeros(n, dtype=np.int64)
    for window, node in enumerate(heap[0][3]):
        stack = [int(node)]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = window
            else:
                stack += [int(left[x]), int(right[x])]
    return out


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; as few windows as differencing fits into the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        if k >= len(sizes):
            return np.arange(len(sizes))
        found = spread(sizes, k)
        if np.bincount(found, weights=sizes, minlength=k).max() <= capacity:
            return found
        k += max(1, k // 200)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, equal to the tokenizers library's for the file.

    A byte-level BPE file whose ids follow its merges is run by tiktoken's faster engine, except for texts with very long runs of blanks."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    fits = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    fits = fits and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    fits = fits and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    if fits:
        vocab, letters = model["vocab"], {c: b for b, c in byte_letters().items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if all(x < y for x, y in zip(made, made[1:])):
            import tiktoken

            ranks = {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in added}
            engine = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
            special = set(added)
            library = functools.cache(lambda: Tokenizer.from_file(path))

            def encode(text: str) -> np.ndarray:
                if len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in re.finditer(r"\s+", text)):
                    ids = library().encode(text, add_special_tokens=False).ids
                elif any(s in text for s in special):
                    ids = engine.encode(text, allowed_special=special, disallowed_special=())
                else:
                    ids = engine.encode_ordinary(text)
                return np.array(ids, dtype=np.uint32)

            return encode
    library = Tokenizer.from_file(path)
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(n: int, capacity: int, small: bool) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, then the rest, in small pieces if asked for."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    at = full * capacity
    if small:
        while n - at > SMALL:
            out.append((at, SMALL))
            at += SMALL
    if n > at:
        out.append((at, n - at))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: (doc_id, start, length, doc_tokens, sequence_id, offset, ids as little-endian unsigned 32-bit).

    A sequence is the pieces of one sequence_id by offset; no sequence is longer than the capacity."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 36
        full: list[tuple] = []
        open_: list[tuple] = []

        def flush(rest: bool) -> pa.RecordBatch:
            nonlocal number, full, open_
            out = full
            if open_ and (rest or len(open_) >= GROUP):
                at = windows_of(np.array([p[2] for p in open_]), capacity)
                ends: dict[int, int] = {}
                for p, w in zip(open_, at.tolist()):
                    out.append((*p[:4], number + w, ends.get(w, 0), p[6]))
                    ends[w] = ends.get(w, 0) + p[2]
                number += int(at.max()) + 1
                open_ = []
            full = []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

        seen = 0
        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(body or ""), np.uint32(end_id)).astype("<u4")
                seen += 1
                for start, length in cuts(len(ids), capacity, seen % FILL == 0):
                    piece = (doc, start, length, len(ids), 0, 0, ids[start : start + length].tobytes())
                    if length == capacity:
                        full.append((*piece[:4], number, 0, piece[6]))
                        number += 1
                    else:
                        open_.append(piece)
                if len(open_) >= GROUP or len(full) >= 4096:
                    yield flush(False)
        yield flush(True)

    return rows.mapInArrow(tidy(run), schema)


def sequences(pieces: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): each sequence's ids in order, padded to the capacity."""
    by = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate(F.col("p"), F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - F.col("length")).cast("int")))
    return by.select("sequence_id", "length", F.concat(joined, pad).alias("ids"))
