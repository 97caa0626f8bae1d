"""Alignment of characters, phonemes and words inside a row: arrays over a text's characters, so nothing is shuffled.

Positions are 0-based code points, words are numbered from 1. What an array function can say is one; a scan that carries a
state, or a search for each place, takes linear time over Arrow batches. Take
what they give apart by outer generators (`rows_from`): below others Spark adds a filter, and would call the function for it again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import chars

SPAN = "array<struct<start: int, end: int>>"
CHARACTERS = "array<struct<uthmani_idx: int, ph_start: int, ph_end: int, deleted: int, uthmani_word: int>>"
MAP = "array<struct<phoneme_word: int, text_word: int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often and however deep in lambdas body uses it."""
    return F.transform(F.array(value), body)[0]


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once, in a step of its own: the optimiser doesn't merge a generator, here of one row,
    with what uses the column. Arrow functions need it for arguments with nested lambdas, which Spark can't move into them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def rows_from(df: DataFrame, keep: list[str], arrays: str) -> DataFrame:
    """The kept columns and, a row each, the structs of an array column."""
    rows = df.select(*keep, F.explode_outer(arrays).alias("one")).where(F.col("one").isNotNull())
    return rows.select(*keep, "one.*")


def word_index(text: Column) -> Column:
    """The word of each character; 0 for the blank itself. Only U+0020 parts words."""
    each = F.transform(F.split(text, " "), lambda w, i: F.concat(F.array_repeat(i + 1, F.length(w)), F.array(F.lit(0))))
    return F.slice(F.flatten(each), F.lit(1), F.length(text))


def offsets(raw: Column, merged: Column) -> Column:
    """The place in `merged` of each character of `raw`, and of its end. The k-th character that isn't a blank lies at the k-th such
    of merged, or beyond its end; a blank takes the next one's place, and what follows the last the place after it."""
    merged = F.coalesce(merged, F.lit(""))
    places = F.filter(F.transform(chars(merged), lambda c, i: F.when(c != " ", i)), lambda i: i.isNotNull())
    words = F.split(raw, " ")
    # blanks before each character and before the end; a character's place less these is its rank, or that of the next one
    blanks = F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.length(w) + 1)))
    solid = F.length(raw) - F.size(words) + 1
    known = F.struct(places.alias("places"), blanks.alias("blanks"), solid.alias("n"), F.length(merged).alias("length"))

    def found(z: Column) -> Column:
        at = lambda k: F.coalesce(F.get(z["places"], k), z["length"] + k - F.size(z["places"]))
        end = F.when(z["n"] > 0, at(z["n"] - 1) + 1).otherwise(0)
        return F.transform(z["blanks"], lambda s, i: F.when(i - s < z["n"], at(i - s)).otherwise(end))

    return F.when(raw.isNotNull(), let(known, found))


def rows_of(a: pa.Array, *fields: str):
    """For each list of an array its values as NumPy arrays, one a field of its structs; None for a null."""
    starts, values = a.offsets.to_numpy(), a.values
    columns = [values.field(f) for f in fields] if fields else [values]
    columns = [c.cast(pa.int32()) if pa.types.is_boolean(c.type) else c for c in columns]
    known = [c.fill_null(NONE).to_numpy(zero_copy_only=False) if c.null_count else c.to_numpy(zero_copy_only=False) for c in columns]
    for i, valid in enumerate(a.is_valid().to_pylist()):
        yield tuple(c[starts[i] : starts[i + 1]] for c in known) if valid else None


NONE = -(1 << 31)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def joined(x: np.ndarray) -> str:
    return x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def under(starts: np.ndarray, ends: np.ndarray, deleted: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) for each phoneme in the range of a character that isn't deleted and has a word; characters beyond the words
    have none. An empty range gives nothing."""
    word = np.zeros(len(starts), np.int64)
    word[: len(words)] = words[: len(starts)]
    some = (deleted == 0) & (word > 0) & (ends > starts)
    first, size = starts[some].astype(np.int64), (ends - starts)[some].astype(np.int64)
    begins = np.cumsum(size) - size
    return np.repeat(first - begins, size) + np.arange(size.sum()), np.repeat(word[some], size)


def broken(x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A text's points without blanks, and a blank before each whose word (its own, NONE if there is none, or the last known)
    exceeds the one before it, if that is above 0."""
    w = np.full(len(x), NONE, np.int64)
    w[: len(least)] = least[: len(x)]
    x, w = x[x != 32], w[x != 32]
    if not len(x):
        return x
    last = np.maximum.accumulate(np.where(w != NONE, np.arange(len(w)), -1))
    word = np.where(last >= 0, w[last], 0)
    before = np.concatenate([[0], word[:-1]])
    return np.insert(x, np.flatnonzero((word > before) & (before > 0)), 32)


def reinserted(text: Column, least: Column) -> Column:
    """The text without blanks, and a blank before each character whose word exceeds the one before it, as in `broken`. least: the
    word of each character, or null."""

    @F.arrow_udf("string")
    def found(texts: pa.Array, words: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), rows_of(words))
        return pa.array([None if body is None or own is None else joined(broken(points(body), own[0])) for body, own in pairs], pa.string())

    return found(text, least)


class Verse:
    """A verse's text, its phonemes as they came, and for each character the range of phonemes that it makes."""

    def __init__(self, text: str, raw: str, mappings: tuple[np.ndarray, ...]) -> None:
        x = points(text)
        self.words = np.where(x == 32, 0, np.cumsum(x == 32) + 1)
        self.raw = points(raw)
        self.starts, self.ends, self.deleted = mappings
        self.place, self.word = under(self.starts, self.ends, self.deleted, self.words)

    def phonemes(self) -> str:
        """With a blank wherever the text's words change."""
        least = np.full(len(self.raw), 1 << 31, np.int64)
        inside = (self.place >= 0) & (self.place < len(least))
        np.minimum.at(least, self.place[inside], self.word[inside])
        return joined(broken(self.raw, np.where(least == 1 << 31, NONE, least)))

    def moved(self, phonemes: str) -> np.ndarray:
        """The place in the phonemes of each raw one and of the end, as in `offsets`."""
        solid = np.flatnonzero(points(phonemes) != 32)
        blank = self.raw == 32
        rank = np.concatenate([np.arange(len(blank)) - (np.cumsum(blank) - blank), [len(blank) - blank.sum()]])
        n = rank[-1]
        beyond = len(phonemes) + np.arange(max(0, n - len(solid)))
        at = np.concatenate([solid, beyond])[:n]
        return np.concatenate([at, [at[-1] + 1 if n else 0]])[rank]

    def characters(self, phonemes: str) -> tuple[np.ndarray, ...]:
        """For each character its place, its range in the phonemes, whether it is deleted, and its word, 0 for a blank or beyond the text."""
        moved = self.moved(phonemes)
        start, end = (moved[np.minimum(p, len(moved) - 1)] for p in (self.starts, self.ends))
        word = np.zeros(len(start), np.int64)
        word[: len(self.words)] = self.words[: len(start)]
        return np.arange(len(start)), start, end, self.deleted, word

    def heard(self, phonemes: str) -> tuple[np.ndarray, np.ndarray]:
        """(place in the phonemes, word) of all raw phonemes that aren't blanks."""
        inside = (self.place >= 0) & (self.place < len(self.raw))
        place, word = self.place[inside], self.word[inside]
        sound = self.raw[place] != 32
        return self.moved(phonemes)[place[sound]], word[sound]


def of_verses(kind: str, make: Callable, *columns: Column) -> Column:
    """make(verse, ...) for each row: text, raw phonemes and mappings, then what make takes more. kind: string, or an array of integers
    or of structs of them, for which make gives an array a field. Null where any is null."""
    fields = [x.split(":")[0].strip() for x in kind.removeprefix("array<struct<").removesuffix(">>").split(",")] if "struct" in kind else []

    @F.arrow_udf(kind)
    def found(texts: pa.Array, raws: pa.Array, mappings: pa.Array, *more: pa.Array) -> pa.Array:
        rest = [rows_of(m, "start", "end") if pa.types.is_list(m.type) else m.to_pylist() for m in more]
        out = []
        for text, raw, own, *given in zip(texts.to_pylist(), raws.to_pylist(), rows_of(mappings, "start", "end", "deleted"), *rest):
            out.append(None if text is None or raw is None or own is None or any(g is None for g in given) else make(Verse(text, raw, own), *given))
        return pa.array(out, pa.string()) if kind == "string" else lists_of(out, fields)

    return found(*columns)


def lists_of(rows: list[tuple[np.ndarray, ...] | None], fields: list[str]) -> pa.Array:
    """Lists of integers, or of structs of them, from arrays a row; None is a null."""
    sizes = np.cumsum([0, *(0 if r is None else len(r[0]) for r in rows)])
    flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows if r is not None)]), pa.int64()).cast(pa.int32()) for k in range(max(1, len(fields)))]
    values = pa.StructArray.from_arrays(flat, names=fields) if fields else flat[0]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


def token_words(verse: Verse, phonemes: str, tokens: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (phoneme_word, text_word), in order: for each token's span the words of the phonemes in it."""
    return distinct(*inside((tokens[0], np.minimum(tokens[1], len(phonemes))), verse.heard(phonemes)))


def distinct(span: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span's number from 1, word) without repeats, in order."""
    code = np.unique((span.astype(np.int64) + 1) << 32 | word)
    return code >> 32, code & 0xFFFFFFFF


def group_words(verse: Verse, phonemes: str, groups: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray]:
    """For each group's span the smallest word of the phonemes in it, 0 where there is none."""
    span, word = inside((groups[0], np.minimum(groups[1], len(phonemes))), verse.heard(phonemes))
    least = np.full(len(groups[0]), 1 << 31, np.int64)
    np.minimum.at(least, span, word)
    return (np.where(least == 1 << 31, 0, least),)


def token_pairs(verse: Verse, phonemes: str) -> tuple[np.ndarray]:
    """How many pairs `token_words` gives for the phonemes' own tokens, as an array of one number."""
    at = np.array(places(phonemes, phonemes.split(), 1), np.int64).reshape(-1, 2)
    return (np.array([len(token_words(verse, phonemes, (at[:, 0], at[:, 1]))[0])]),)


def places(text: str, parts: list[str], gap: int) -> list[tuple[int, int]]:
    """[start, end) of each part, as in `spans`."""
    at, out = 0, []
    for part in parts:
        begin = text.find(part, at)
        begin = at if begin < 0 else begin
        out.append((begin, begin + len(part)))
        at = begin + len(part) + gap
    return out


def spans(text: Column, parts: Column, gap: int = 0) -> Column:
    """[start, end) of each part, found from the end of the one before (plus gap) on; one that isn't found starts there.

    The search is a chain: where a part starts depends on every one before it. Null for a null text or null parts."""

    @F.arrow_udf(SPAN)
    def found(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for body, own in zip(texts.to_pylist(), lists.to_pylist()):
            if body is None or own is None:
                out.append(None)
                continue
            out.append([{"start": x, "end": y} for x, y in places(body, own, gap)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return found(text, parts)


def token_spans(text: Column) -> Column:
    """[start, end) of each token of a text whose tokens are parted by single blanks: from one blank to the next."""
    blanks = F.filter(F.transform(chars(text), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), blanks, F.array(F.length(text)))

    def between(e: Column) -> Column:
        return F.transform(F.slice(e, F.lit(2), F.size(e) - 1), lambda end, i: F.struct((F.get(e, i) + 1).alias("start"), end.alias("end")))

    return let(edges, between)


def inside(spans_, pairs_):
    """For NumPy spans and (place, word) pairs: (span, word) of every pair whose place lies in the span."""
    (start, end), (place, word) = spans_, pairs_
    order = np.argsort(place, kind="stable")
    place, word = place[order], word[order]
    first, last = np.searchsorted(place, start), np.searchsorted(place, end)
    n = np.maximum(last - first, 0)
    begins = np.cumsum(n) - n
    return np.repeat(np.arange(len(n)), n), word[np.repeat(first - begins, n) + np.arange(n.sum())]


def word_map(tokens: Column, starts: Column, ends: Column, deleted: Column, words: Column) -> Column:
    """Distinct (phoneme_word, text_word), in order: for each token's span the words of the phonemes in it. tokens: start, end; then,
    for each character, the range of its phonemes, whether it is deleted, and its word."""

    @F.arrow_udf(MAP)
    def found(lists: pa.Array, *known: pa.Array) -> pa.Array:
        rows = zip(rows_of(lists, "start", "end"), *map(rows_of, known))
        return lists_of([None if own is None or None in of else distinct(*inside(own, under(*(x[0] for x in of)))) for own, *of in rows], ["phoneme_word", "text_word"])

    return found(tokens, starts, ends, deleted, words)


def local(heard: Column, known: Column, match: int = 2, mismatch: int = -1, gap: int = -1) -> Column:
    """The best local alignment of two token arrays (Smith and Waterman): score, and where it lies in each, [start, end). The scores
    are parameters (they aren't documented); of equal scores the first end counts, and diagonal steps before gaps. Score 0: an
    empty alignment."""

    @F.arrow_udf("struct<score: int, heard_start: int, heard_end: int, known_start: int, known_end: int>")
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        names = ("score", "heard_start", "heard_end", "known_start", "known_end")
        out = [None if x is None or y is None else dict(zip(names, aligned(x, y, match, mismatch, gap))) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array(out, pa.struct([(n, pa.int32()) for n in names]))

    return found(heard, known)


def aligned(a: list, b: list, match: int, mismatch: int, gap: int) -> tuple[int, int, int, int, int]:
    """Row by row, each cell with the start that its best path has, so no table of steps is kept."""
    best = (0, 0, 0, 0, 0)
    above = [(0, 0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(0, i, 0)]
        for j, y in enumerate(b, 1):
            ways = [(above[j - 1][0] + (match if x == y else mismatch), *above[j - 1][1:]), (above[j][0] + gap, *above[j][1:]), (row[j - 1][0] + gap, *row[j - 1][1:])]
            score = max(w[0] for w in ways)
            row.append(next(w for w in ways if w[0] == score) if score > 0 else (0, i, j))
            if score > best[0]:
                best = (score, row[j][1], i, row[j][2], j)
        above = row
    return best


def or_identity(pairs: Column, n: Column) -> Column:
    """The (phoneme_word, text_word) pairs, or each of n words to itself where there are none."""
    same = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("phoneme_word"), k.alias("text_word")))
    return F.when(F.size(F.coalesce(pairs, F.array().cast(MAP))) > 0, pairs).when(n > 0, same)
