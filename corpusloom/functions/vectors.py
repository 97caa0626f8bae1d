"""Comparisons of numeric arrays as column expressions; sums are in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is added to the product of the norms.
EPSILON = 1e-12


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def differences(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


def max_abs(a: Column, b: Column) -> Column:
    return F.array_max(differences(a, b))


def mean_abs(a: Column, b: Column) -> Column:
    return total(differences(a, b)) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(EPSILON))


def argmax(a: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def same_size(a: Column, b: Column) -> Column:
    """Null, or an error if the arrays differ in length."""
    return F.assert_true(F.size(a) == F.size(b), F.lit("arrays differ in length"))


def quantized(a: Column) -> Column:
    """Symmetric 8-bit values of an array (an extension: scale is max|x| / 127)."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127
    return F.transform(a, lambda x: F.when(scale > 0, F.rint(x.cast("double") / scale)).otherwise(F.lit(0.0)).cast("int"))


def palettized(a: Column, bits: int, rounds: int = 20) -> Column:
    """The array with each value replaced by the nearest of 2^bits levels, found by one-dimensional k-means from evenly spaced
    quantiles (an extension: the algorithm isn't given). Arrow batches, since levels depend on all values of the array."""

    @F.arrow_udf("array<float>")
    def found(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else palette(np.array(x, np.float64), 1 << bits, rounds).tolist() for x in lists.to_pylist()], pa.list_(pa.float32()))

    return found(a)


def palette(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """x with each value at its level; with k distinct values or fewer, x itself."""
    if len(np.unique(x)) <= k:
        return x
    levels = np.quantile(x, (np.arange(k) + 0.5) / k)
    for _ in range(rounds):
        near = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        n = np.bincount(near, minlength=k)
        levels = np.sort(np.where(n > 0, np.bincount(near, weights=x, minlength=k) / np.maximum(n, 1), levels))
    return levels[np.searchsorted((levels[1:] + levels[:-1]) / 2, x)]


def standardized(frames: Column) -> Column:
    """Frames (arrays of one size) with each bin at mean 0 and variance 1 over the frames, the variance with n - 1; a bin
    without variance gives zeros, and fewer than two frames nulls."""
    n = F.size(frames)
    wide = F.transform(F.sequence(F.lit(0), F.size(F.get(frames, F.lit(0))) - 1), lambda k: F.transform(frames, lambda f: F.get(f, k).cast("double")))

    def scaled(bins: Column) -> Column:
        means = F.transform(bins, lambda b: total(b) / n)
        centred = F.zip_with(bins, means, lambda b, m: F.transform(b, lambda x: x - m))
        return F.transform(centred, lambda b: F.transform(F.array(F.sqrt(total(F.transform(b, lambda x: x * x)) / F.nullif(n - 1, F.lit(0)))), lambda s: F.transform(b, lambda x: F.when(s > 0, x / s).when(s == 0, 0.0)))[0])

    done = F.transform(F.array(wide), scaled)[0]
    return F.when(n > 0, F.transform(F.array(done), lambda bins: F.transform(frames, lambda f, i: F.transform(bins, lambda b: F.get(b, i))))[0]).otherwise(frames.cast("array<array<double>>"))


#: Fixed values of the sound front end: samples of a frame, length of the transform, factor of the preemphasis, least energy.
FRAME, TRANSFORM, EMPHASIS, FLOOR = 400, 512, 0.97, 1.192092955078125e-07


def mel_frames(samples: Column, filters: np.ndarray, hop: int = 160) -> Column:
    """Logarithmic energies of each frame under a bank of filters (bands x 257). The bank and the hop are parameters (they aren't
    documented); samples beyond the last whole frame don't count. Arrow batches: a transform needs all samples of a frame."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)

    @F.arrow_udf("array<array<float>>")
    def found(lists: pa.Array) -> pa.Array:
        out = []
        for own in lists.to_pylist():
            if own is None:
                out.append(None)
                continue
            x = np.array(own, np.float64) * 32768
            n = max(0, 1 + (len(x) - FRAME) // hop)
            frames = x[np.arange(n)[:, None] * hop + np.arange(FRAME)]
            frames = frames - frames.mean(axis=1, keepdims=True)
            before = np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
            power = np.abs(np.fft.rfft((frames - EMPHASIS * before) * window, TRANSFORM, axis=1)) ** 2
            out.append(np.log(np.maximum(power @ np.asarray(filters, np.float64).T, FLOOR)).tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    return found(samples)


def stacked(frames: Column) -> Column:
    """Each frame of an even place joined with the next one; a last frame without a next one goes."""
    return F.transform(F.filter(frames, lambda f, i: (i % 2 == 0) & (i + 1 < F.size(frames))), lambda f, i: F.concat(f, F.get(frames, 2 * i + 1)))


def greedy_decoded(logits: Column, blank: int = 0) -> Column:
    """Classes of a frame sequence by greedy connectionist decoding: the largest of each frame, repeats as one, without the blank.
    The blank's number is a parameter (it isn't documented)."""
    best = F.transform(logits, argmax)
    kept = lambda seen: F.filter(seen, lambda c, i: (c != blank) & ((i == 0) | (c != F.get(seen, i - 1))))
    return F.transform(F.array(best), kept)[0]
