"""Periodic runs of words by harmonic grid probing.

A run is a maximal stretch of words of smallest period p that is at least ``min_words`` long and
holds its period ``MIN_TURNS`` times. For every period p the words at jp, (j+1)p and (j+2)p are
compared on the grid of p, about n log n comparisons in all: a run of three periods holds three
such words, whatever its start. Periods are taken in doubling ranges; within a range either each
period is one strided comparison or, for long periods, each grid number is one comparison over all
periods, so a text of n words takes about sqrt(n) array steps. Survivors are extended by
comparing chunks of doubling size.

Grid points inside a found run are skipped: if a run of a smaller period covers all three words, the
stretch around them can't have p as its smallest period (it would share over p + q words with
that run), so nothing is lost and periodic texts are not probed over and over. By the same rule
the first period that is found for a stretch is its smallest.

Everything is local to a row: one scan, no shuffle, memory in proportion to the longest text.

Defined results: a null or empty text has no words and no runs, and collapses to an empty text;
repeated rows are searched one by one; an empty table gives an empty result. A column that is
called like the new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import space_words, with_struct

MIN_WORDS = 24
MIN_TURNS = 3
FIRST_CHUNK = 32

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _probed(ids: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the grid points of the periods low..high-1 whose next two are equal words."""
    n = len(ids)
    periods, places = [], []
    if low * low <= n:
        for p in range(low, high):
            grid = ids[::p]
            same = grid[1:] == grid[:-1]
            at = np.flatnonzero(same[1:] & same[:-1])
            if len(at):
                periods.append(np.full(len(at), p))
                places.append(at * p)
    else:
        for j in range(n // low - 1):
            end = min(high, (n - 1) // (j + 2) + 1)
            if end <= low:
                break
            one, two, three = (ids[k * low : k * (end - 1) + 1 : k] if k else ids[:1] for k in (j, j + 1, j + 2))
            p = np.flatnonzero((one == two) & (two == three)) + low
            if len(p):
                periods.append(p)
                places.append(p * j)
    if not periods:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(periods), np.concatenate(places)


def _right(ids: np.ndarray, at: int, period: int) -> int:
    """The first place from ``at`` on whose word differs from the one a period later (or has none)."""
    size, last = FIRST_CHUNK, len(ids) - period
    while at < last:
        end = min(at + size, last)
        differs = ids[at:end] != ids[at + period : end + period]
        if differs.any():
            return at + int(differs.argmax())
        at, size = end, 2 * size
    return last


def _left(ids: np.ndarray, at: int, period: int) -> int:
    """The first place up to ``at`` from which on all words equal the one a period later."""
    size = FIRST_CHUNK
    while at > 0:
        begin = max(0, at - size)
        differs = (ids[begin:at] != ids[begin + period : at + period])[::-1]
        if differs.any():
            return at - int(differs.argmax())
        at, size = begin, 2 * size
    return 0


def _uncovered(found: list[tuple[int, int, int]], periods: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which probes aren't inside one found run."""
    ordered = np.array(sorted((start, start + length) for start, length, _ in found))
    reach = np.maximum.accumulate(ordered[:, 1])
    k = np.searchsorted(ordered[:, 0], places, "right") - 1
    return (k < 0) | (reach[np.maximum(k, 0)] <= places + 2 * periods)


def periodic_runs(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, low, found = len(ids), 1, []
    while MIN_TURNS * low <= n and n >= min_words:
        high = min(2 * low, n // MIN_TURNS + 1)
        periods, places = _probed(ids, low, high)
        if len(periods):
            # a run that holds a probe repeats every word of its first period there
            for share in (0.0, 0.5):
                at = places + np.maximum(1, (periods * share).astype(np.int64))
                held = ids[at] == ids[at + periods]
                periods, places = periods[held], places[held]
        if len(periods) and found:
            held = _uncovered(found, periods, places)
            periods, places = periods[held], places[held]
        order = np.lexsort((places, periods))
        looked, until = 0, 0  # the period and the end of the stretch that was extended last
        for p, at in zip(periods[order].tolist(), places[order].tolist(), strict=True):
            if p == looked and at + 2 * p < until:
                continue
            start, until, looked = _left(ids, at, p), _right(ids, at, p) + p, p
            if until - start >= max(min_words, MIN_TURNS * p) and at + 2 * p < until:  # else another probe holds it
                found.append((start, until - start, p))
        low *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def planted(words: list[bytes], key: int) -> list[bytes]:
    """The words, of which the last ones are made periodic if ``key`` ends in 0."""
    n = len(words)
    if key % 10 or not n:
        return words
    g = key // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + period]
    return words[:a] + (block * ((n - a) // period + 1))[: n - a]


def _found(texts: list, min_words: int) -> Iterator[tuple]:
    for text in texts:
        text, key = text if isinstance(text, tuple) else (text, None)
        words = space_words(text)
        if key is not None:
            words = planted(words, key)
        runs = periodic_runs(_numbered(words), min_words) if len(words) >= min_words else []
        yield len(words), runs, b" ".join(kept_words(words, runs))


def collapsed(docs: DataFrame, name: str, plant: F.Column | None = None, min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, the runs and the text with each run's repeats dropped.

    ``plant``, an unsigned number or null a row, makes the end of some texts periodic first, to
    measure what is found.
    """
    return with_struct(docs, name, f"n_words bigint, runs array<{RUN}>, collapsed string", lambda texts: _found(texts, min_words), keep=keep, beside=plant)


def strongest(runs) -> F.Column:
    """Of an array of runs by start, then period, that of greatest length / period; the first of equals."""
    best = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    return F.reduce(runs, F.lit(None).cast(RUN), best)
