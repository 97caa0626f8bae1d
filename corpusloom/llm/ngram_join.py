"""N-gram Jaccard join by multiple-global-order filtering.

Two sets with Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 tokens of each, under
any order of all tokens. Candidates must share such prefix tokens under several orders; only pairs that pass
all of them are verified on the whole sets.

1. Documents are dealt to blocks. A block sends each token of a fixed region of the hash space once, with its
   count, to the token's bucket; buckets answer with the tokens that several documents hold.
2. The first order takes the region's tokens by rising frequency, then the others. A document whose prefix has
   only tokens of its own has no partner. The others keep their sets.
3. Documents with one set are one node. Nodes that share a prefix token join the group of that token's smallest
   node; large groups are parted by classes of size, of which only equal and neighbouring ones can hold similar sets, and
   these are cut into chunks, which meet pair by pair, so no task holds a large group.
4. In a unit, pairs that share prefix tokens under every order are verified exactly, unless links found before
   connect them already. Links become components.

Defined cases: a null text is an empty one; a document without words has an empty set and is linked with nothing;
one with fewer words than a shingle has one shingle; null doc_ids never are a component's id unless all its are
null; rows that repeat a doc_id are documents of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import block_count, block_of, cut, fresh, mix64, named, tidy
from corpusloom.llm.graph import components
from corpusloom.llm.shingles import Powers, shingle_sets

#: Share of the hash space whose tokens are counted over all documents. It must exceed 1 - threshold clearly.
REGION = 0.2
#: Token orders that must agree on a pair.
ORDERS = 3
#: Sets in a chunk; a unit holds two chunks.
CHUNK = 256
OUTSIDE = 255
#: Bytes of a set's digest that name its node; nodes that several digests would share are told apart by the other half.
NODE_BYTES = 8


def prefix(n: int, percent: int) -> int:
    """Tokens that the prefix of a set of n has, for similarity of at least percent / 100."""
    return n - -(-percent * n // 100) + 1


def size_class(n: int, percent: int) -> int:
    """Sets that are similar by at least percent / 100 lie in one class or in neighbouring ones: the smaller has that share of the
    larger's tokens at least."""
    if percent <= 0:
        return 0
    return n if percent >= 100 else int(math.log(n) / (math.log(100 / percent) * 1.0001))


def docs_of(table: pa.Table, width: int, powers: Powers) -> Iterator[tuple[int | None, np.ndarray]]:
    for b in table.to_batches(max_chunksize=512):
        yield from zip(b["doc_id"].to_pylist(), shingle_sets(b["text"].to_pylist(), width, powers))


def counted(blocks: int, region: int, width: int):
    """Step 1, a block: its tokens of the region by bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        powers, limit = Powers(), np.uint64(region)
        tokens = [s[: np.searchsorted(s, limit)] for _, s in docs_of(table, width, powers)]
        token, count = np.unique(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), return_counts=True)
        # one blob a bucket: a bucket is a stretch of the region
        bounds = np.searchsorted(token, np.array([region * k // blocks for k in range(1, blocks)], dtype=np.uint64))
        parts = [(k, t, c) for k, (t, c) in enumerate(zip(np.split(token, bounds), np.split(count, bounds))) if len(t)]
        return pa.table({
            "bucket": pa.array([k for k, _, _ in parts], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "tokens": pa.array([t.astype("<u8").tobytes() for _, t, _ in parts], pa.binary()),
            "counts": pa.array([np.minimum(c, 255).astype("u1").tobytes() for _, _, c in parts], pa.binary()),
        })

    return run


def shared(key: tuple, table: pa.Table) -> pa.Table:
    """Step 1, a bucket: to each block its tokens that several documents hold, with a class of their frequency."""
    blocks = table["block"].to_numpy()
    tokens = [np.frombuffer(x, "<u8") for x in table["tokens"].to_pylist()]
    all_tokens = np.concatenate(tokens)
    counts = np.concatenate([np.frombuffer(x, "u1") for x in table["counts"].to_pylist()]).astype(np.int64)
    token, at = np.unique(all_tokens, return_inverse=True)
    total = np.bincount(at, weights=counts).astype(np.int64)
    kind = np.minimum(np.ceil(np.log2(np.maximum(total, 1))), 200).astype("u1")
    out, first = [], 0
    for b, t in zip(blocks.tolist(), tokens):
        k = kind[at[first : first + len(t)]]
        first += len(t)
        if (k > 0).any():
            out.append((b, t[k > 0].tobytes(), k[k > 0].tobytes()))
    return pa.table({"block": pa.array([o[0] for o in out], pa.int32()), "tokens": pa.array([o[1] for o in out], pa.binary()), "kinds": pa.array([o[2] for o in out], pa.binary())})


ROW = "doc_id long, n long, node long, low long, tokens binary, kinds binary"


def suspected(region: int, width: int, percent: int):
    """Step 2, a block: (doc_id, n, node, low, tokens, kinds); node and low are a digest of the set. Only possible partners have a node, and of equal
    sets in the block the first keeps the tokens."""

    def run(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        powers, limit = Powers(), np.uint64(region)
        token = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in reply["tokens"].to_pylist())])
        kind = np.concatenate([np.zeros(0, "u1"), *(np.frombuffer(x, "u1") for x in reply["kinds"].to_pylist())])
        order = np.argsort(token)
        token, kind = token[order], kind[order]
        rows, seen = [], set()
        for doc, s in docs_of(table, width, powers):
            n = len(s)
            row = (doc, n, None, None, None, None)
            if n:
                inside = s[: np.searchsorted(s, limit)]
                at = np.searchsorted(token, inside)
                at[at == len(token)] = 0
                kinds = np.full(n, OUTSIDE, "u1")
                kinds[: len(inside)] = np.where(token[at] == inside, kind[at], 0) if len(token) else 0
                if (kinds[: len(inside)] == 0).sum() < prefix(n, percent):
                    sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    own = (s.astype("<u8").tobytes(), kinds.tobytes()) if sig not in seen else (None, None)
                    seen.add(sig)
                    row = (doc, n, int.from_bytes(sig[:NODE_BYTES], "little", signed=True), int.from_bytes(sig[8:], "little", signed=True), *own)
            rows.append(row)
        kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({name.split()[0]: pa.array([r[k] for r in rows], kinds_of[k]) for k, name in enumerate(ROW.split(", "))})

    return run


def prefix_tokens(tokens: np.ndarray, kinds: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The set's prefix under an order: tokens of the region by class of frequency, then the others; within a class
    by a hash that differs by order."""
    mixed = tokens if order == 0 else mix64(tokens ^ np.uint64(0x9E3779B97F4A7C15 * order & (1 << 64) - 1))
    return tokens[np.lexsort((mixed, kinds))[: prefix(len(tokens), percent)]]


def postings(percent: int):
    """Step 3: (token, node, class of size) of the first order's prefixes, without tokens that only one document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, node, size = [], [], []
            for i, t, k in zip(*(b.column(c).to_pylist() for c in ("node", "tokens", "kinds"))):
                t, k = np.frombuffer(t, "<u8"), np.frombuffer(k, "u1")
                p = prefix_tokens(t, k, 0, percent)
                p = p[k[np.searchsorted(t, p)] > 0]
                token.append(p)
                node.append(np.full(len(p), i))
                size.append(np.full(len(p), size_class(len(t), percent), np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(node), pa.int64()), pa.array(np.concatenate(size), pa.int32())], names=["token", "node", "size"])

    return run


def candidates(left: list, right: list | None, percent: int) -> np.ndarray:
    """Pairs (as left * len(right) + right) that share prefix tokens under every order. right None: pairs within left."""
    other = left if right is None else right
    both = None
    for order in range(ORDERS):
        lt, li = lay([prefix_tokens(t, k, order, percent) for t, k in left])
        rt, ri = (lt, li) if right is None else lay([prefix_tokens(t, k, order, percent) for t, k in right])
        first, last = np.searchsorted(rt, lt, "left"), np.searchsorted(rt, lt, "right")
        n = last - first
        a = np.repeat(li, n)
        b = ri[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        code = np.unique((a * len(other) + b)[a < b] if right is None else a * len(other) + b)
        both = code if both is None else np.intersect1d(both, code, assume_unique=True)
        if not len(both):
            break
    return both


def lay(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sets in order, each with its set's number."""
    token, number = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    return token[order], number[order]


def overlaps(left: list, right: list) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over stretches of the tokens that both sides hold."""
    lt, li = lay([t for t, _ in left])
    rt, ri = lay([t for t, _ in right])
    common = np.intersect1d(lt, rt)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        sides = []
        for token, number, n in ((lt, li, len(left)), (rt, ri, len(right))):
            x, y = np.searchsorted(token, part[0], "left"), np.searchsorted(token, part[-1], "right")
            t, i = token[x:y], number[x:y]
            column = np.searchsorted(part, t)
            fits = part[np.minimum(column, len(part) - 1)] == t
            m = np.zeros((n, len(part)), np.float32)
            m[i[fits], column[fits]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def linked(left: list, right: list | None, percent: int) -> list[tuple[int, int]]:
    """Step 4: links that span the components of the pairs in a unit; numbers count left, then right."""
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    codes = candidates(left, right, percent)
    if codes is None or not len(codes):
        return []
    a, b = np.divmod(codes, len(other))
    na, nb = np.array([len(t) for t, _ in left]), np.array([len(t) for t, _ in other])
    fits = (100 * np.minimum(na[a], nb[b]) >= percent * np.maximum(na[a], nb[b]))
    a, b = a[fits], b[fits]
    parent = list(range(shift + len(other)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    if len(a) > 1500:
        size = overlaps(left, other)[a, b]
        good = 100 * size >= percent * (na[a] + nb[b] - size)
        a, b, sure = a[good], b[good], True
    else:
        sure = False
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j + shift)
        if x == y:
            continue
        if not sure:
            size = len(np.intersect1d(left[i][0], other[j][0], assume_unique=True))
            if 100 * size < percent * (na[i] + nb[j] - size):
                continue
        parent[y] = x
        out.append((i, j + shift))
    return out


def unit(percent: int):
    """Step 4: one unit, with the groups that it holds."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        groups: dict[int, tuple[list, list]] = {}
        for lead, side, node, t, k in zip(*(table[c].to_pylist() for c in ("lead", "side", "node", "tokens", "kinds"))):
            groups.setdefault(lead, ([], []))[side].append((node, (np.frombuffer(t, "<u8"), np.frombuffer(k, "u1"))))
        for left, right in groups.values():
            names = [n for n, _ in left + right]
            links = linked([s for _, s in left], [s for _, s in right] if right else None, percent) if left else []
            out += [(names[i], names[j]) for i, j in links]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def by_whole_digest(found: DataFrame) -> DataFrame:
    """found with a node for each digest: nodes of several digests get new ones, made of both halves. Of n sets some n^2 / 2^65 clash,
    so the table of these is next to nothing."""
    halves = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("low").alias("least"), F.max("low").alias("most"))
    clashes = cut(halves.where(F.col("least") != F.col("most")).select("node", F.lit(True).alias("clash")))
    if clashes.isEmpty():
        return found
    node = F.when(F.col("clash"), F.xxhash64("node", "low")).otherwise(F.col("node"))
    return found.join(clashes, "node", "left").select("doc_id", "n", node.alias("node"), "low", "tokens", "kinds")


def join(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: its set's size, and the smallest doc_id reachable by links."""
    region = int(max(REGION, 2 * (100 - percent) / 100) * 2**64) if percent < 100 else int(REGION * 2**64)
    region = min(region, (1 << 64) - 1)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = block_count(rows)
    dealt = rows.withColumn("block", block_of(n, "doc_id", "text"))
    sent = dealt.groupBy("block").applyInArrow(tidy(counted(n, region, width)), "bucket int, block int, tokens binary, counts binary")
    reply = sent.groupBy("bucket").applyInArrow(tidy(shared), "block int, tokens binary, kinds binary")
    found = cut(dealt.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(tidy(suspected(region, width, percent)), ROW))

    found = by_whole_digest(found)
    holders = found.where(F.col("tokens").isNotNull())
    post = cut(holders.select("node", "tokens", "kinds").mapInArrow(tidy(postings(percent)), "token long, node long, size int").distinct())
    leads = cut(post.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where(F.col("lead") != F.col("last")).select("token", "lead"))
    members = cut(post.join(leads, "token").select("lead", "node", "size").distinct())
    counted_by = members.groupBy("lead", "size").agg(F.count("*").alias("n"))
    sizes = cut(counted_by.groupBy("lead").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("size", F.ceil(F.col("n") / CHUNK).cast("int")))).alias("chunks")))  # classes: some 10 a power of ten
    units = max(1, -(-members.count() // CHUNK))
    placed = members.join(sizes, "lead")
    few = placed.where(F.col("n") <= CHUNK).select("lead", "node", F.lit(0).alias("side"), block_of(units, "lead").cast("long").alias("unit"))
    chunks = lambda k: F.coalesce(F.try_element_at("chunks", F.col("size") + k), F.lit(0))
    many = placed.where(F.col("n") > CHUNK).withColumn("i", F.pmod(F.xxhash64("node", "lead"), chunks(0)).cast("int"))

    def chunks_of(k: int) -> Column:
        """The chunks of the class k beside a node's own."""
        numbers = F.when(chunks(k) > 0, F.sequence(F.lit(0), chunks(k) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda j: F.struct((F.col("size") + k).alias("size"), j.alias("i")))

    each = [chunks_of(k) for k in (-1, 0, 1)]  # its own class and the two beside it
    many = many.withColumn("own", F.struct("size", "i")).withColumn("other", F.explode(F.concat(*each)))
    many = many.select(
        "lead", "node", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.xxhash64("lead", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
    )
    # of blocks that hold the same set, one gives the tokens
    given = holders.select("node", "doc_id", "tokens", "kinds").withColumn("giver", block_of(1 << 30, "doc_id"))
    giver = cut(given.groupBy("node").agg(F.min("giver").alias("giver")))
    wanted = few.union(many).join(giver, "node")
    work = wanted.join(given, ["node", "giver"]).select("unit", "lead", "side", "node", "tokens", "kinds")
    links = work.groupBy("unit").applyInArrow(tidy(unit(percent)), "a long, b long")
    roots = components(links)

    nodes = cut(found.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least")))
    rooted = cut(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_node = cut(rooted.join(least, "root").select("node", "component_id"))
    with_node = found.where(F.col("node").isNotNull()).select("doc_id", "n", "node").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = found.where(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_node.union(alone)


def one_of_each(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, less those whose component has a smaller doc_id. Rows without an id stay, whatever they
    hold; of equal rows with one id, one stays; an empty table stays empty."""
    found = join(docs, width, percent, key, text)
    gone = cut(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct())
    kept = docs.join(gone, key, "left_anti").select(*named(docs))
    again = cut(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return kept
    rest = kept.join(again, key, "left_anti").select(*named(docs))
    mark = fresh(docs, "equal_rows")
    # rows are told apart by two hashes of all they hold, as JSON, since maps can't be compared
    whole = F.to_json(F.struct(*named(docs)), {"ignoreNullFields": "false"})
    several = kept.join(again, key, "left_semi").select(F.struct(*named(docs)).alias(mark), F.sha2(whole, 256).alias("row_digest"))
    single = several.groupBy("row_digest").agg(F.any_value(mark).alias(mark))
    return rest.union(single.select(f"{mark}.*"))
