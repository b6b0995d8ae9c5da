"""Hashes of words and of runs of words, on whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; longer texts are cut at white space.
BLOCK = 1 << 21
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over the whole 64-bit number; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _space(d: np.ndarray) -> np.ndarray:
    return (d == 32) | ((d >= 9) & (d <= 13))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the start and the end of each word (what lies between the bytes 9 to 13 and 32), in order."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        d = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(~_space(d), prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        up, down = _powers(len(d) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((d.astype(np.uint64) + np.uint64(1)) * up[: len(d)], dtype=np.uint64)])
        out.append((mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(56)), starts + at, ends + at))
        at = end
    none = np.zeros(0, np.int64)
    h, starts, ends = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (none.astype(np.uint64), none, none)
    return h, starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    return word_spans(text)[0]


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive words; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total = total * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
        return mix(total)
    up, down = _powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``n`` words, or of the whole sequence if it is shorter; empty without words."""
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


class OnePermutation:
    """One-permutation MinHash with optimal densification.

    The range of hashes is cut into ``bins`` equal parts and a bin's value is its least hash. An empty bin
    borrows from the bin that its own sequence of random probes meets first, the same sequence for all sets,
    so two sets agree in a bin with the probability of their similarity.
    """

    def __init__(self, bins: int, seed: int = 1):
        self.bins = bins
        self.edges = np.array([(i << 64) // bins for i in range(bins)], np.uint64)
        self.random = np.random.default_rng(seed)
        self.probes: list[np.ndarray] = []

    def _probe(self, t: int) -> np.ndarray:
        while len(self.probes) <= t:
            self.probes.append(self.random.integers(0, self.bins, self.bins))
        return self.probes[t]

    def sketch(self, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values by bin and which bins have one of their own."""
        at = np.searchsorted(sorted_set, self.edges)
        ends = np.append(at[1:], len(sorted_set))
        full = ends > at
        return np.where(full, sorted_set[np.minimum(at, len(sorted_set) - 1)], np.uint64(0)), full

    def densify(self, values: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Rows of values without gaps; each row has a full bin."""
        out, open_row, open_bin = values.copy(), *np.nonzero(~full)
        t = 0
        while len(open_row):
            source = self._probe(t)[open_bin]
            hit = full[open_row, source]
            # a borrowed value also tells which bin it fills, so equal values in unlike bins stay apart
            out[open_row[hit], open_bin[hit]] = values[open_row[hit], source[hit]]
            open_row, open_bin, t = open_row[~hit], open_bin[~hit], t + 1
        return out


def _band_salts(bands: int) -> np.ndarray:
    return mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def band_keys(dense: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each row: 64 / rows bits of each of its values, so a row's keys also are its sketch; bands do not share keys."""
    width = 64 // rows
    total = np.zeros((len(dense), bands), np.uint64)
    for k in range(rows):
        total = (total << np.uint64(width)) | (mix(dense[:, k : bands * rows : rows]) >> np.uint64(64 - width))
    return total ^ _band_salts(bands)


def likeness(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The share of equal values in the sketches whose keys are the rows of ``a`` and ``b`` (signed or not)."""
    kind = {1: np.uint64, 2: np.uint32, 4: np.uint16, 8: np.uint8}[rows]
    return ((a ^ b).view(kind) == 0).mean(axis=1)


def blocks(sizes: list[int], limit: int = BLOCK) -> Iterator[range]:
    """Consecutive items whose sizes sum to the limit at most (or single ones)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield range(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield range(start, len(sizes))
