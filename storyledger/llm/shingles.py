"""Weighted word shingles and their consistent samples, as array code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np

WORDS = 5
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
SMOOTH = 16.0  # a shingle of one group weighs as one of so many, so small counts hardly matter
FOLDS = 4  # plain least hashes by which texts are folded to groups
FINE_BANDS, FINE_ROWS = 16, 6
FINE_SAMPLES = FINE_BANDS * FINE_ROWS
BINS = 128  # a power of two: sums of the weights of a text, by the first bits of their hashes
SKETCH_DEPTH = 2
LEAST_WIDTH, MOST_WIDTH, WIDTH_PER_SHINGLE = 1 << 16, 1 << 20, 64
SLICE = 1 << 19  # bytes handled at once
TILE = 1 << 10  # shingles sampled at once; all samples of so many stay in the processor's cache
U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _byte_table(word_byte: int, other: int) -> bytes:
    """Translation of bytes of words to themselves, lower-cased, plus ``word_byte``; of all others to ``other``."""
    lowered = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    inside = [128 <= b < 255 or 48 <= b <= 57 or 97 <= b <= 122 for b in lowered]
    return bytes(b + word_byte if held else other for b, held in zip(lowered, inside, strict=True))


CODES = _byte_table(1, 0)  # 255 is in no UTF-8
SPACED = _byte_table(0, 32)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    base = 0x9E3779B97F4A7C15
    powers = np.cumprod(np.full(SLICE * 2, base, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(SLICE * 2, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)
    return powers, inverse


def _hash_slice(codes: np.ndarray) -> np.ndarray:
    powers, inverse = _powers()
    n = len(codes)
    inside = np.zeros(n + 2, np.bool_)
    np.not_equal(codes, 0, out=inside[1:-1])
    starts = np.flatnonzero(inside[1:] != inside[:-1])[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Bytes between words add nothing, so a word's sum may reach to the next one.
    return mix(np.add.reduceat(codes * powers[:n], starts) * inverse[starts])


def words_digest(text: str) -> str:
    """Digest of the words of a text, the same as ``words_key`` of near_dup."""
    return md5(b" ".join(text.encode("utf-8").translate(SPACED).split()), usedforsecurity=False).hexdigest()


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word of ``text``, in order; long texts are cut between words."""
    data = np.frombuffer(text.encode("utf-8").translate(CODES), np.uint8)
    if len(data) <= SLICE:
        return _hash_slice(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(data[at:stop] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a slice: hashed in full on its own
                rest = np.flatnonzero(data[stop:] == 0)
                stop = stop + int(rest[0]) if len(rest) else len(data)
                folded = np.zeros(1, np.uint64)
                for i in range(at, stop, SLICE):
                    folded = mix(folded * U(31) + _hash_slice(data[i : min(i + SLICE, stop)]))
                parts.append(folded)
                at = stop
                continue
        parts.append(_hash_slice(data[at:stop]))
        at = stop
    return np.concatenate(parts)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``WORDS`` consecutive words, sorted, and how often each occurs.

    A text of fewer words, but not none, is one shingle.
    """
    words = word_hashes(text)
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = max(len(words) - WORDS + 1, 1)
    joined = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        joined = joined * U(0xD6E8FEB86659FD93) + words[i : i + n]
    return np.unique(mix(joined), return_counts=True)


def least_hashes(hashes: np.ndarray) -> list[int]:
    """``FOLDS`` independent least hashes of a set; sets at Jaccard J share each with probability J."""
    if not len(hashes):
        return []
    return [int(mix(hashes * U(2 * k + 3)).min().view(np.int64)) for k in range(FOLDS)]


def set_digest(hashes: np.ndarray) -> int:
    """64 bits that tell sets of hashes apart."""
    return int(mix(hashes ^ U(0xD1B54A32D192ED03)).sum(dtype=np.uint64).view(np.int64))


def grams(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash, for the sketch."""
    return (hashes >> U(32)).astype(np.uint32)


def sketch_width(mean: float) -> int:
    """Slots of a row of the sketch: so many for each shingle of a mean text, within bounds, as a power of two."""
    wanted = max(int(mean * WIDTH_PER_SHINGLE), 1)
    return min(max(1 << (wanted - 1).bit_length(), LEAST_WIDTH), MOST_WIDTH)


def sketch_slots(own: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Slot of each gram in each row of the sketch, numbered through."""
    bits = np.uint32(width.bit_length() - 1)
    for row, odd in enumerate((0x9E3779B1, 0x85EBCA6B)):
        yield ((own * np.uint32(odd)) >> (np.uint32(32) - bits)).astype(np.int64) + row * width


def idf_table(counts: np.ndarray, n_groups: int) -> np.ndarray:
    """Inverse document frequency of every slot: log(1 + groups / (groups with it + ``SMOOTH`` - 1))."""
    return np.log1p(max(n_groups, 1) / (np.maximum(counts, 1) + SMOOTH - 1))


def weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of each shingle. Of its slots the one with the least count, so the largest idf, is right."""
    slots = sketch_slots(grams(hashes), len(idf) // SKETCH_DEPTH)
    return times * np.maximum.reduce([idf[s] for s in slots])


def weight_bins(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights in each of ``BINS`` bins. Two texts share no more than the sum of the smaller sums."""
    places = (hashes >> U(64 - BINS.bit_length() + 1)).astype(np.intp)
    return np.bincount(places, weight, minlength=BINS).astype(np.float32)


@lru_cache(maxsize=2)
def _gamma(first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), their logarithms, and multipliers of the samples from ``first`` on."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < share
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    seeds = mix(np.arange(first + 1, first + count + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    return low.astype(np.float32), np.log(low).astype(np.float32), seeds, mix(seeds)


@lru_cache(maxsize=2)
def _space(count: int) -> tuple[np.ndarray, ...]:
    size = count * TILE
    return np.empty((2, size), np.uint64), np.empty(size, np.intp), np.empty((4, size), np.float32)


def _scratch(count: int, n: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Arrays of ``count`` by ``n`` that every call uses again: two of 64 bits, one of indices, four of floats."""
    wide, places, floats = _space(count)
    size = count * n
    return [x[:size].reshape(count, n) for x in wide], places[:size].reshape(count, n), [x[:size].reshape(count, n) for x in floats]


def consistent_samples(hashes: np.ndarray, weight: np.ndarray, first: int = 0, count: int = SAMPLES) -> np.ndarray:
    """``count`` consistent weighted samples: equal in two sets with probability their weighted Jaccard.

    Those from another ``first`` on are independent of these.
    """
    gamma, log_gamma, times, plus = _gamma(first, count)
    log_weight = np.log(weight).astype(np.float32)
    rows = np.arange(count)
    least = np.full(count, np.inf, np.float32)
    out, steps = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    for at in range(0, len(hashes), TILE):
        own, log_own = hashes[at : at + TILE], log_weight[at : at + TILE]
        wide, places, floats = _scratch(count, len(own))
        z, shifted = wide
        np.multiply(own[None, :], times[:, None], out=z)
        z += plus[:, None]
        z ^= np.right_shift(z, U(32), out=shifted)
        z *= U(0xD6E8FEB86659FD93)
        z ^= np.right_shift(z, U(29), out=shifted)
        # Bits 0-15 choose r, bits 16-31 log c, bits 40-63 beta; indices always fit their tables.
        short, (r, log_a, beta, t) = z.view("<u2").reshape(count, -1, 4), floats
        np.copyto(places, short[:, :, 0])
        np.take(gamma, places, mode="clip", out=r)
        np.copyto(places, short[:, :, 1])
        np.take(log_gamma, places, mode="clip", out=log_a)
        np.copyto(beta, np.right_shift(z, U(40), out=shifted).view(np.int64), casting="unsafe")
        beta *= np.float32(2.0**-24)
        np.divide(log_own[None, :], r, out=t)
        t += beta
        np.floor(t, out=t)
        np.subtract(t, beta, out=beta)
        beta *= r
        log_a -= beta
        log_a -= r
        best = log_a.argmin(1)
        value = log_a[rows, best]
        better = value < least
        least = np.where(better, value, least)
        out = np.where(better, own[best], out)
        steps = np.where(better, t[rows, best].astype(np.int64).astype(np.uint64) & U(0xFFFFFFFF), steps)
    return mix(out ^ (steps * U(0xA24BAED4963EE407)))


def band_keys(samples: np.ndarray, bands: int = BANDS, per_band: int = ROWS) -> np.ndarray:
    """One key for each band of ``per_band`` samples."""
    rows = samples.reshape(bands, per_band)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(per_band):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + rows[:, i])
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger; both sides sorted by hash."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole > 0 else 0.0
