"""Suffix-array dedup: bytes covered by a string that also starts in a document with a smaller doc_id are removed.

1. Every string of `length` bytes has one anchor: of its 20-byte substrings the one with the smallest hash, the
   first of equals. Equal strings have equal anchors. Blocks of documents send the anchors that they hold to
   buckets, which answer with those that several documents hold.
2. A run of strings with one shared anchor makes a context: the bytes that the run covers. Contexts go to the
   bucket of their anchor; a block sends equal contexts once, for the smallest of its documents, and decides
   the others by itself. A frequent anchor's runs are cut by their place around it, and each piece goes by the
   bytes that all its strings share, so no bucket gets a frequent anchor whole.
3. A bucket sorts the suffixes of its distinct contexts in two stages; adjacent common prefixes of at least
   `length` bytes show which strings a smaller document has too.
4. Blocks merge the answers into spans and cut them out.

Texts with equal digests are copies: all but the smallest doc_id are removed whole, without contexts.

Defined cases: a null text is an empty one; texts shorter than `length` stay; rows that repeat a doc_id aren't
smaller than one another, so none removes from the other; a null doc_id counts as larger than any; very long texts
are read in overlapping pieces; an empty table gives an empty result; other columns are ignored or pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.llm.common import block_count, block_of, fresh, mix64, named, tidy
from corpusloom.llm.shingles import Powers
from corpusloom.llm.suffixes import repeated

ANCHOR = 20
#: Bytes whose anchors are found in one go; a longer text is cut into pieces that overlap.
PIECE = 1 << 20
LOW = np.uint64((1 << 24) - 1)
#: Anchors that 2^FREQUENT documents or more hold are cut by place, in classes of PLACES places.
FREQUENT = 6
PLACES = 8
#: Contexts that are sorted in one go, in bytes; an anchor's contexts stay together.
SORTED = 1 << 20
NONE = np.iinfo(np.int64).max


class Text:
    """Some texts as one run of bytes, with the hash of any stretch of it at hand."""

    def __init__(self, parts: list[bytes], powers: Powers) -> None:
        self.x = np.frombuffer(b"".join(parts), np.uint8)
        self.bounds = np.cumsum([0, *map(len, parts)])
        up, self.down = powers.get(len(self.x) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers.letters[self.x] * up[: len(self.x)])])

    def hash(self, first: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[end] - self.total[first]) * self.down[first] + np.asarray(salt, np.uint64))

    def runs(self, length: int) -> tuple[np.ndarray, ...]:
        """Runs of strings with one anchor: (part, first start, last start, anchor's place, anchor's hash)."""
        n, width, bounds = len(self.x), length - ANCHOR + 1, self.bounds
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
        if n < length:
            return none
        with np.errstate(over="ignore"):
            h = mix64((self.total[ANCHOR:] - self.total[: n - ANCHOR + 1]) * self.down[: n - ANCHOR + 1])
        least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & LOW).astype(np.int64)
        part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
        at = np.flatnonzero(np.arange(len(anchor)) + length <= bounds[part + 1])
        if not len(at):
            return none
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor[at]) != 0) | (np.diff(part[at]) != 0))
        first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
        # smallest hashes are small numbers; mixed again, they spread evenly over the buckets
        return part[first], first, last, anchor[first], mix64(h[anchor[first]] ^ np.uint64(0x9E3779B97F4A7C15))


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first..first + size - 1 of every pair, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def pieces(rows: list[tuple[int, bytes]], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Batches of texts: (row, offset) and bytes of each part. Every string lies in one part."""
    names, parts, size = [], [], 0
    for row, text in rows:
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if size and size + len(part) > PIECE:
                yield names, parts
                names, parts, size = [], [], 0
            names.append((row, at))
            parts.append(part)
            size += len(part)
    if parts:
        yield names, parts


def texts_of(table: pa.Table) -> list[tuple[int, bytes]]:
    """(doc_id, bytes) of each row, from the columns before the block; a null doc_id as the largest number."""
    ids = [NONE if i is None else i for i in table.column(table.num_columns - 3).to_pylist()]
    return [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(ids, table.column(table.num_columns - 2).to_pylist())]


def in_order(texts: list[tuple[int, bytes]]) -> list[int]:
    """The places of a block's rows by doc_id and text. Spark hands a group's rows over in any order, so a row is known
    by its rank here; rows of equal rank differ in no byte and get the same spans."""
    return sorted(range(len(texts)), key=texts.__getitem__)


def digest(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def bucket_bounds(n: int) -> np.ndarray:
    return np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)


SENT = "bucket int, block int, tokens binary, counts binary, high binary, low binary, docs binary"


def table_of(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in ddl.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(names)})


def anchors(blocks: int, length: int):
    """Step 1, a block: its anchors and its texts' digests, by bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        powers, bounds = Powers(), bucket_bounds(blocks)
        copies: dict[tuple[int, int], int] = {}
        own = []
        for k, (doc, text) in enumerate(texts_of(table)):
            if len(text) < length:
                continue
            d = digest(text)
            if d not in copies:
                own.append((k, text))
            copies[d] = min(doc, copies.get(d, NONE))
        tokens, counts = [], []
        last_row = None
        for names, parts in pieces(own, length):
            p, _, _, _, h = Text(parts, powers).runs(length)
            row = np.array([r for r, _ in names])[p] if len(p) else p
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
            token, count = np.unique(h[new], return_counts=True)
            tokens.append(token)
            counts.append(count)
            last_row = names[-1][0]
        token = np.concatenate([np.zeros(0, np.uint64), *tokens])
        token, at = np.unique(token, return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(token))
        high = np.array([d[0] for d in copies], np.uint64)
        order = np.argsort(high, kind="stable")
        high, low = high[order], np.array([d[1] for d in copies], np.uint64)[order]
        docs = np.array(list(copies.values()), np.int64)[order]
        t, c = np.searchsorted(token, bounds), np.searchsorted(high, bounds)
        rows = []
        for k, (a, b, x, y, z) in enumerate(zip(np.split(token, t), np.split(count, t), np.split(high, c), np.split(low, c), np.split(docs, c))):
            if len(a) or len(x):
                rows.append((k, key[0].as_py(), a.astype("<u8").tobytes(), np.minimum(b, 255).astype("u1").tobytes(), x.astype("<u8").tobytes(), y.astype("<u8").tobytes(), z.astype("<i8").tobytes()))
        return table_of(SENT, rows)

    return run


REPLY = "block int, tokens binary, kinds binary, high binary, low binary, docs binary"


def held_by_several(key: tuple, table: pa.Table) -> pa.Table:
    """Step 1, a bucket: to each block its shared anchors with a class of frequency, and the smallest copies of its texts."""
    tokens = [np.frombuffer(x, "<u8") for x in table["tokens"].to_pylist()]
    token, at = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([np.frombuffer(x, "u1") for x in table["counts"].to_pylist()]), minlength=len(token))
    kind = np.minimum(np.floor(np.log2(np.maximum(total, 1))), 60).astype("u1")
    digests = [list(zip(*(np.frombuffer(x, t).tolist() for x, t in zip(r, ("<u8", "<u8", "<i8"))))) for r in zip(*(table[c].to_pylist() for c in ("high", "low", "docs")))]
    least: dict[tuple[int, int], int] = {}
    for own in digests:
        for h, l, d in own:
            least[h, l] = min(d, least.get((h, l), NONE))
    rows, first = [], 0
    for block, t, own in zip(table["block"].to_pylist(), tokens, digests):
        k = kind[at[first : first + len(t)]]
        first += len(t)
        other = [(h, l, least[h, l]) for h, l, d in own if least[h, l] < d]
        if not other and not (k > 0).any():
            continue
        rows.append((block, t[k > 0].tobytes(), k[k > 0].tobytes(), *(np.array([o[i] for o in other], x).tobytes() for i, x in enumerate(("<u8", "<u8", "<i8")))))
    return table_of(REPLY, rows)


CONTEXTS = "bucket int, block int, keys binary, docs binary, sizes binary, data binary, holds binary, rows binary, starts binary, spans binary"


def cut_by_place(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, text: Text, length: int) -> tuple[np.ndarray, ...]:
    """Runs of frequent anchors cut into classes of PLACES places around the anchor: (run, first, last, key). All strings
    of a class hold the same bytes at the class's place; their hash is the key."""
    low, high = (anchor - last) // PLACES, (anchor - first) // PLACES
    run = np.repeat(np.arange(len(first)), high - low + 1)
    place = stretches(low, high - low + 1)
    core = anchor[run] - PLACES * place
    key = text.hash(core, core - PLACES + 1 + length, place + 1)
    return run, np.maximum(first[run], core - PLACES + 1), np.minimum(last[run], core), key


def contexts(blocks: int, length: int):
    """Step 2, a block: contexts by bucket, and the spans that it decides by itself."""

    def run(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        powers, block = Powers(), key[0].as_py()
        token = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in reply["tokens"].to_pylist())])
        kind = np.concatenate([np.zeros(0, "u1"), *(np.frombuffer(x, "u1") for x in reply["kinds"].to_pylist())])
        order = np.argsort(token)
        token, kind = token[order], kind[order]
        least: dict[tuple[int, int], int] = {}
        for columns in zip(*(reply[c].to_pylist() for c in ("high", "low", "docs"))):
            least.update({(h, l): d for h, l, d in zip(*(np.frombuffer(x, t).tolist() for x, t in zip(columns, ("<u8", "<u8", "<i8"))))})
        texts = texts_of(table)
        texts = [texts[k] for k in in_order(texts)]
        digests = [digest(t) if len(t) >= length else None for _, t in texts]
        for d, (doc, _) in zip(digests, texts):
            if d is not None:
                least[d] = min(doc, least.get(d, NONE))
        spans = [np.array([(k, 0, len(t)) for k, ((doc, t), d) in enumerate(zip(texts, digests)) if d is not None and least[d] < doc], np.int64).reshape(-1, 3)]
        own = [(k, t) for k, ((doc, t), d) in enumerate(zip(texts, digests)) if d is not None and least[d] == doc]
        docs = np.array([d for d, _ in texts], np.int64)
        found, bodies, base = [], [], 0
        for names, parts in pieces(own, length):
            text = Text(parts, powers)
            p, first, last, anchor, h = text.runs(length)
            if len(token) and len(p):
                at = np.minimum(np.searchsorted(token, h), len(token) - 1)
                hit = token[at] == h
                often = hit & (kind[at] >= FREQUENT)
                few, many = np.flatnonzero(hit & ~often), np.flatnonzero(often)
                cut_run, x, y, cut_key = cut_by_place(first[many], last[many], anchor[many], text, length)
                p = np.concatenate([p[few], p[many][cut_run]])
                first, last, name = np.concatenate([first[few], x]), np.concatenate([last[few], y]), np.concatenate([h[few], cut_key])
                rows, offsets = np.array([r for r, _ in names])[p], np.array([o for _, o in names])[p]
                found.append((name, text.hash(first, last + length, last - first), rows, offsets + first - text.bounds[p], last + length - first, base + first))
            bodies.append(text.x)
            base += len(text.x)
        rows_out = []
        if found:
            name, context, row, start, size, at = (np.concatenate(c) for c in zip(*found))
            body, doc = np.concatenate(bodies), docs[row]
            order = np.lexsort((start, row, doc, context, name))
            name, context, row, start, size, at, doc = (c[order] for c in (name, context, row, start, size, at, doc))
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (context[1:] != context[:-1])])
            group, head = np.cumsum(new) - 1, np.flatnonzero(new)
            later = doc > doc[head][group]  # the block has the same context in a smaller document
            spans.append(np.stack([row[later], start[later], (start + size)[later]], axis=1))
            holds = np.bincount(group[~later], minlength=len(head))
            row, start = row[~later], start[~later]
            name, doc, size, at = (c[head] for c in (name, doc, size, at))
            data = body[stretches(at, size)]
            e = np.concatenate([[0], np.searchsorted(name, bucket_bounds(blocks)), [len(name)]])
            ends, places = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(holds)])
            for b in np.flatnonzero(np.diff(e)).tolist():
                x, y = e[b], e[b + 1]
                part, place = slice(x, y), slice(places[x], places[y])
                rows_out.append((
                    b, block, name[part].astype("<u8").tobytes(), doc[part].astype("<i8").tobytes(), size[part].astype("<u4").tobytes(),
                    packed(data[ends[x] : ends[y]]), holds[part].astype("<u4").tobytes(), row[place].astype("<u4").tobytes(), start[place].astype("<i8").tobytes(), None,
                ))
        decided = np.concatenate(spans)
        if len(decided):
            rows_out.append((block % blocks, block, *[None] * 7, decided.astype("<i8").tobytes()))
        return table_of(CONTEXTS, rows_out)

    return run


def packed(data: np.ndarray) -> bytes:
    """Bytes as they go through the shuffle; text shrinks to a third."""
    return pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each context."""
    up, down = powers.get(int(size.max()) + 1)
    with np.errstate(over="ignore"):
        terms = powers.letters[data] * up[np.arange(len(data)) - np.repeat(at, size)]
        return mix64(np.add.reduceat(terms, at) + size.astype(np.uint64))


def sorted_suffixes(length: int):
    """Step 3, a bucket: (block, spans) with rows of (row, start, end)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out: dict[int, list[bytes]] = {}
        columns: list[list[np.ndarray]] = [[] for _ in range(10)]
        powers = Powers()
        base = 0
        for r in table.to_pylist():
            if r["spans"] is not None:
                out.setdefault(r["block"], []).append(r["spans"])
                continue
            size, holds = np.frombuffer(r["sizes"], "<u4").astype(np.int64), np.frombuffer(r["holds"], "<u4").astype(np.int64)
            data, at = unpacked(r["data"], int(size.sum())), np.cumsum(size) - size
            some = (np.frombuffer(r["keys"], "<u8"), hashes(data, at, size, powers), np.frombuffer(r["docs"], "<i8"), size, base + at, np.full(len(size), r["block"]), holds, np.frombuffer(r["rows"], "<u4").astype(np.int64), np.frombuffer(r["starts"], "<i8"), data)
            for c, v in zip(columns, some):
                c.append(v)
            base += len(data)
        if base:
            name, context, doc, size, at, block, holds, row, start, body = (np.concatenate(c) for c in columns)
            place = np.cumsum(holds) - holds
            order = np.lexsort((doc, context, name))
            name, context, doc, size, at, block, holds, place = (c[order] for c in (name, context, doc, size, at, block, holds, place))
            new_name = np.concatenate([[True], name[1:] != name[:-1]])
            count = np.bincount(np.cumsum(new_name) - 1)
            lone = np.repeat(count == 1, count)  # one context of one block: nothing to compare it with
            name, context, doc, size, at, block, holds, place = (c[~lone] for c in (name, context, doc, size, at, block, holds, place))
        if base and len(name):
            new_name = np.concatenate([[True], name[1:] != name[:-1]])
            new = new_name | np.concatenate([[True], context[1:] != context[:-1]])
            group, head = np.cumsum(new) - 1, np.flatnonzero(new)
            firsts, lasts, which = [], [], []
            # batches of whole keys, of about SORTED bytes each
            total = np.cumsum(size[head])
            starts_key = np.flatnonzero(new_name[head])
            batch = (total[starts_key] - size[head][starts_key]) // SORTED
            edges = np.concatenate([starts_key[np.concatenate([[True], batch[1:] != batch[:-1]])], [len(head)]])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                h = head[x:y]
                c, f, l = repeated(body, at[h], size[h], doc[h], length)
                which.append(c + x)
                firsts.append(f)
                lasts.append(l)
            which, firsts, lasts = np.concatenate(which), np.concatenate(firsts), np.concatenate(lasts)
            # what the smallest holder of a context repeats, and whole contexts for its other holders
            later = doc > doc[head][group]
            bounds = np.searchsorted(which, np.arange(len(head) + 1))
            n = np.where(later, 1, np.diff(bounds)[group])
            entry = np.repeat(np.arange(len(doc)), n)
            pick = stretches(np.where(later, 0, bounds[group]), n)
            whole = later[entry]
            some = np.minimum(pick, max(len(firsts) - 1, 0))
            f = np.where(whole, 0, firsts[some] if len(firsts) else 0)
            l = np.where(whole, size[entry] - length, lasts[some] if len(firsts) else 0)
            held = holds[entry]
            at_place = stretches(place[entry], held)
            f, l, b = np.repeat(f, held), np.repeat(l, held), np.repeat(block[entry], held)
            spans = np.stack([row[at_place], start[at_place] + f, start[at_place] + l + length], axis=1)
            order = np.argsort(b, kind="stable")
            spans, b = spans[order], b[order]
            cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
            for part, one in zip(np.split(spans, cuts), b[np.concatenate([[0], cuts])].tolist() if len(b) else []):
                out.setdefault(one, []).append(part.astype("<i8").tobytes())
        return table_of("block int, spans binary", [(b, b"".join(s)) for b, s in out.items()])

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching (start, end) pairs as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[new, 0], np.concatenate([ends[:-1][new[1:]], ends[-1:]])], axis=1)


def applied(keep: list[str], text: str | None, count: str | None):
    """Step 4, a block: the kept columns, the bytes of the text, (start, end) of the removed spans, and the bytes that
    stay. text, count: columns that get what stays of the text, without broken characters, and its length."""

    def run(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        spans = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x, "<i8").reshape(-1, 3) for x in reply["spans"].to_pylist())])
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        bounds = np.searchsorted(spans[:, 0], np.arange(table.num_rows + 1))
        texts = texts_of(table)
        rank = np.empty(len(texts), np.int64)
        rank[in_order(texts)] = np.arange(len(texts))
        gone, kept, sizes = [], [], []
        for k, (_, body) in zip(rank.tolist(), texts):
            own = spans[bounds[k] : bounds[k + 1], 1:]
            sizes.append(len(body))
            if not len(own):
                gone.append([])
                kept.append(body)
                continue
            own = merged(own)
            gone.append([{"start": a, "end": b} for a, b in own.tolist()])
            edges = [0, *own.ravel().tolist(), len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
        columns = [table.column(k) for k in range(len(keep))]
        if text is not None:
            k = keep.index(text)
            left = [x.decode("utf-8", "ignore") if g else old for x, g, old in zip(kept, gone, columns[k].to_pylist())]
            columns[k] = pa.array(left, columns[k].type)
            if count in keep:
                k = keep.index(count)
                columns[k] = pa.array([len(x) if g else old for x, g, old in zip(left, gone, columns[k].to_pylist())], columns[k].type)
        columns += [pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(columns, names=[*keep, "bytes", "spans", "kept"])

    return run


def removed(docs: DataFrame, keep: list[str], length: int, key: str, text: str, rewrite: bool = False, count: str | None = None) -> DataFrame:
    """The kept columns of every row, then three: its bytes, the spans that go, the bytes that stay."""
    doc, body, place = "dealt_doc", "dealt_text", "dealt_block"
    names = dict(zip(docs.columns, named(docs)))
    rows = docs.select(*[names[c].alias(f"c{k}") for k, c in enumerate(keep)], F.col(key).cast("long").alias(doc), F.col(text).alias(body))
    n = block_count(rows, body)
    block = rows.withColumn(place, block_of(n, doc, body)).groupBy(place)
    sent = block.applyInArrow(tidy(anchors(n, length)), SENT)
    reply = sent.groupBy("bucket").applyInArrow(tidy(held_by_several), REPLY)
    asked = block.cogroup(reply.groupBy("block")).applyInArrow(tidy(contexts(n, length)), CONTEXTS)
    spans = asked.groupBy("bucket").applyInArrow(tidy(sorted_suffixes(length)), "block int, spans binary")
    last = StructType([StructField(fresh(docs, x), t) for x, t in zip(("bytes", "spans", "kept"), (f.dataType for f in StructType.fromDDL("a long, b array<struct<start: long, end: long>>, c binary").fields))])
    out = StructType([*docs.select(*[names[c] for c in keep]).schema.fields, *last.fields])
    run = applied(keep, text if rewrite else None, count)
    labels = out.names
    return block.cogroup(spans.groupBy("block")).applyInArrow(tidy(lambda key, left, right: run(key, left, right).rename_columns(labels)), out)


def dedup(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: bytes of the text, (start, end) of what goes, the bytes that stay."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return removed(rows, ["doc_id"], length, "doc_id", "text").toDF("doc_id", "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", count: str = "n_chars") -> DataFrame:
    """The rows of docs, with all columns, and what stays of each text. A character of which a byte went goes too;
    a length column is set anew, and rows of whose text nothing is left go."""
    found = removed(docs, docs.columns, length, key, text, True, count)
    size, _, kept = found.columns[-3:]
    return found.where((F.col(size) == 0) | (F.octet_length(kept) > 0)).select(*named(docs))
