"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpusloom.llm.common import mix64

#: Text that is hashed in one go; longer texts make their own batch.
BATCH = 1 << 20
_LOWER = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as long as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])
        return self.up[:n], self.down[:n]


def batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BATCH):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def shingle_sets(texts: list[str | None], width: int, powers: Powers) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `width` words, sorted; words are parted by ASCII blanks and A-Z is
    lower-cased. A text with fewer words has one shingle, its whole sequence; one without words has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    for at, end in batches(raw):
        part = raw[at:end]
        b = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        firsts = np.cumsum([0, *(len(p) + 1 for p in part)])
        word = b != 32
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        up, down = powers.get(len(b) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers.letters[b] * up[: len(b)])])
            h = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            bounds = np.searchsorted(starts, firsts)
            s = h * np.uint64(_ODD[0])
            for k in range(1, width):
                s[: max(0, len(s) - k)] += h[k:] * np.uint64(_ODD[k % len(_ODD)] + 2 * (k // len(_ODD)))
            s = mix64(s)
        for i in range(end - at):
            x, y = int(bounds[i]), int(bounds[i + 1])
            n = y - x
            if n >= width:
                yield np.unique(s[x : y - width + 1])
            elif n:
                with np.errstate(over="ignore"):
                    whole = np.uint64(n)
                    for v in h[x:y]:
                        whole = whole * np.uint64(_BASE) + v
                    yield mix64(np.array([whole ^ np.uint64(0x5BD1E9955BD1E995)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
