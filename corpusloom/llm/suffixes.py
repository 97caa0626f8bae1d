"""A suffix array by two-stage sorting, and the passages that it shows to repeat."""

from __future__ import annotations

import numpy as np


def words8(x: np.ndarray) -> np.ndarray:
    """For each place the next 8 bytes as one big-endian number; zeros follow the end."""
    padded = np.concatenate([x, np.zeros(64, np.uint8)])
    n = len(x) + 56
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * (7 - k))
    return out


def smaller_than_next(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it. The end counts as smaller than any byte."""
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    differs = np.flatnonzero(x[1:] != x[:-1])
    at = np.searchsorted(differs, np.arange(n))  # the next place whose byte differs from its successor
    out = np.zeros(n, bool)
    inside = at < len(differs)
    place = differs[at[inside]]
    out[inside] = x[place] < x[place + 1]
    return out


def sort_directly(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their first `depth` bytes (rounded up to eights): by 8 bytes, ties by the next 8, and so on."""
    if not len(at):
        return at
    order = np.argsort(word[at], kind="stable")
    at = at[order]
    w = word[at]
    tied = np.concatenate([[False], w[1:] == w[:-1]])
    for k in range(8, depth, 8):
        member = tied | np.concatenate([tied[1:], [False]])
        places = np.flatnonzero(member)
        if not len(places):
            break
        group = np.cumsum(~tied[places])
        w = word[np.minimum(at[places] + k, len(word) - 1)]
        order = np.lexsort((w, group))
        at[places], w = at[places][order], w[order]
        tied[places] &= np.concatenate([[False], w[1:] == w[:-1]])
    return at


def suffix_array(x: np.ndarray, depth: int, word: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of x in order of their first `depth` bytes at least.

    Only suffixes smaller than their successors are sorted. The others follow by one scan over the buckets of first
    bytes: in the order in which a suffix is met, its predecessor, if larger, takes the next free place of its
    own bucket. Within a bucket the induced ones come first."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    word = words8(x) if word is None else word
    small = smaller_than_next(x)
    direct = sort_directly(np.flatnonzero(small), word, depth)
    bounds = np.searchsorted(x[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[x[n - 1]].append(np.array([n - 1]))  # the end comes before all and induces the last suffix
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        induced[c] = []
        met = []
        while len(wave):
            met.append(wave)
            wave = predecessors(wave, x, small, c, induced)
        own = direct[bounds[c] : bounds[c + 1]]
        predecessors(own, x, small, c, induced)
        out += [*met, own]
    return np.concatenate(out)


def predecessors(met: np.ndarray, x: np.ndarray, small: np.ndarray, c: int, induced: list[list[np.ndarray]]) -> np.ndarray:
    """Puts the larger predecessors of the suffixes met in bucket c into their buckets, in order; returns those of bucket c."""
    before = met[met > 0] - 1
    before = before[~small[before]]
    first = x[before]
    same = before[first == c]
    before, first = before[first != c], first[first != c]
    if len(before):
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part, d in zip(np.split(before, cuts), first[np.concatenate([[0], cuts])]):
            induced[d].append(part)
    return same


def equal_to_previous(sa: np.ndarray, word: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of each suffix and the one before it in the array has at least `length` bytes."""
    same = np.ones(len(sa), bool)
    same[:1] = False
    for k in range(0, length, 8):
        at = np.flatnonzero(same)
        a, b = word[sa[at] + k], word[sa[at - 1] + k]
        if (rest := length - k) < 8:
            shift = np.uint64(8 * (8 - rest))
            a, b = a >> shift, b >> shift
        same[at] = a == b
    return same


def repeated(body: np.ndarray, at: np.ndarray, size: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of `length` bytes that a context of a smaller owner has too, as runs: (context, first start, last start).

    Context i is size[i] bytes of body from at[i] on."""
    first = np.concatenate([[0], np.cumsum(size + 1)])
    x = np.zeros(first[-1], np.uint8)
    target = np.arange(first[-1])
    which = np.repeat(np.arange(len(size)), size + 1)
    inside = target - first[which] < size[which]
    x[inside] = body[(at[which] + target - first[which])[inside]]
    word = words8(x)
    sa = suffix_array(x, length, word)
    group = np.cumsum(~equal_to_previous(sa, word, length)) - 1
    whole = target + length <= first[which] + size[which]
    owner = np.where(whole[sa], owners[which[sa]], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(owner, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
    found = np.zeros(len(x) + 1, np.int8)
    found[sa] = whole[sa] & (least[group] < owners[which[sa]])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found])))  # no run reaches a context's last byte
    begin, end = edge[::2], edge[1::2] - 1
    return which[begin], begin - first[which[begin]], end - first[which[begin]]
