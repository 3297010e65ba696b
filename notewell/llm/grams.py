"""64-bit hashes of words and word sequences, computed over whole blocks with NumPy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed together; longer texts are cut at white space.
SLICE_BYTES = 2_000_000

_SEED = np.random.default_rng(20240101)
_ODD = _SEED.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_BYTE = _SEED.integers(0, 2**64, 256, np.uint64)
_BASE = int(_SEED.integers(0, 2**64, dtype=np.uint64)) | 5
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0..n of an odd number modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held)
    return held


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    out = values ^ (values >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every run of bytes between white space."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, np.int8)
    gap[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(np.diff(gap))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw))[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64)), starts, ends - starts


def _cuts(data: bytes) -> list[int]:
    """Places at white space, about SLICE_BYTES apart."""
    at = [0]
    while len(data) - at[-1] > SLICE_BYTES:
        end = at[-1] + SLICE_BYTES
        spaces = [p for p in (data.find(c, end) for c in (b" ", b"\n")) if p >= 0]
        if not spaces:
            break
        at.append(min(spaces))
    return [*at, len(data)]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs between ``\\x20\\x09-\\x0D``) of all texts, bounds, and lengths in bytes.

    There is one bound more than there are texts: text k has words [bounds[k]] to [bounds[k + 1]].
    """
    data = b"\n".join(t or b"" for t in texts)
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    hashes, starts, lengths = [], [], []
    cuts = _cuts(data)
    for low, high in zip(cuts, cuts[1:], strict=False):
        h, s, n = _hashed(data[low:high])
        lengths.append(n)
        hashes.append(h)
        starts.append(s + low)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, begins), np.concatenate(lengths)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _ODD[k]
    return mixed(total)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of every window."""
    n = len(values) - width + 1
    place, least = np.arange(n), values[:n].copy()
    for k in range(1, width):
        smaller = values[k : k + n] < least
        least[smaller] = values[k : k + n][smaller]
        place[smaller] = np.flatnonzero(smaller) + k
    return place


class Tally:
    """Counts of 64-bit keys in bounded memory; a key met once between two merges is forgotten."""

    MERGED = 2_000_000

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        if sum(map(len, self.held)) > self.MERGED:
            self._merge()

    def _merge(self) -> None:
        keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
        again = counts > 1
        self.held = []
        self.keys, where = np.unique(np.concatenate([self.keys, keys[again]]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts[again]]), len(self.keys)).astype(np.int64)

    def at_least(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self._merge()
        return self.keys[self.counts >= n], self.counts[self.counts >= n]


class PartialCounts:
    """Exact counts of 64-bit keys, handed on in parts whenever ``most`` keys are held."""

    def __init__(self, most: int = 2_000_000) -> None:
        self.most, self.held = most, []

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.held.append(keys)
        return self.flush() if sum(map(len, self.held)) > self.most else None

    def flush(self) -> tuple[np.ndarray, np.ndarray] | None:
        keys = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        self.held = []
        return np.unique(keys, return_counts=True) if len(keys) else None
