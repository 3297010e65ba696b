"""Benchmark decontamination with suffix arrays over the training text.

Each shard (a block of whole documents inside a task) gets a sorted suffix array over its words;
every suffix of every benchmark item is binary-searched in it. Words that no item has are no
symbols of the search, and only suffixes that start a run of benchmark words long enough for a
window enter the array, so it stays sparse without losing a match. Consecutive window hits on a
diagonal join into longest verbatim matches with their places in both texts.

The job is one scan without a shuffle: shards don't depend on each other. The benchmark goes to
the tasks in blocks of at most ``BLOCK_WORDS`` words (counted before anything is sent); of a larger
one, one block at a time is fetched and searched, and what it found is written before the next.

Of equal windows in one item the first counts, so that the hits of a text grow with its own length
whatever repeats in it or in the item; a match inside text with a period is reported in pieces of
at most a period.

Defined results: a null text has no words; an item without words has no window and an item of
fewer than ``window`` words is one window; the windows of items with a null id count like all
others, as matches with a null id; repeated documents each get their own row; repeated items count
once by id; empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace, alnum_words, fresh_name, with_struct

WINDOW = 10
#: Words of benchmark text sent to the tasks at once.
BLOCK_WORDS = 2_000_000

FOUND = "n_words bigint, n_hit bigint, matches array<struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>>"


class TestSuffixes:
    """The distinct windows of each item by length, as rows of word numbers (from 1)."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids = [item for item, _ in items]
        found: dict[int, list] = {}
        for at, (_, text) in enumerate(items):
            words = alnum_words(text)
            row = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.uint32)
            size = min(window, len(row))
            seen: set[bytes] = set()
            for start in range(len(row) - size + 1) if size else ():
                window_ = row[start : start + size]
                if (key := window_.tobytes()) not in seen:
                    seen.add(key)
                    found.setdefault(size, []).append((window_, at, start))
        self.window = window
        self.shortest = min(found, default=0)
        self.by_length = [
            (size, np.array([r for r, _, _ in rows], np.uint32), np.array([a for _, a, _ in rows]), np.array([s for _, _, s in rows]))
            for size, rows in sorted(found.items())
        ]

    def keys(self, rows: np.ndarray, fill: int) -> np.ndarray:
        """Rows as byte strings that sort like the word sequences; short rows end in ``fill``."""
        full = np.full((len(rows), self.window), fill, ">u4")
        full[:, : rows.shape[1]] = rows
        return full.view(f"S{4 * self.window}").ravel()


def _hits(tests: TestSuffixes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, item start, position) of each window occurrence in a shard; 0 ends documents."""
    none = np.empty(0, np.int64)
    if not tests.shortest or not len(words):
        return none, none, none
    breaks = np.flatnonzero(words == 0)
    at = np.arange(len(words))
    run = np.append(breaks, len(words))[np.searchsorted(breaks, at)] - at
    starts = np.flatnonzero(run >= tests.shortest)
    if not len(starts):
        return none, none, none
    padded = np.append(words, np.zeros(tests.window, words.dtype))
    rows = padded[starts[:, None] + np.arange(tests.window)]
    rows[np.arange(tests.window) >= run[starts][:, None]] = 0
    keys = tests.keys(rows, 0)
    order = np.argsort(keys, kind="stable")
    suffixes, sorted_keys = starts[order], keys[order]
    items, offsets, places = [], [], []
    for size, windows, item, offset in tests.by_length:
        low = np.searchsorted(sorted_keys, tests.keys(windows, 0), "left")
        high = np.searchsorted(sorted_keys, tests.keys(windows, 0 if size == tests.window else 0xFFFFFFFF), "right")
        for k in np.flatnonzero(high > low):
            here = suffixes[low[k] : high[k]]
            places.append(here)
            items.append(np.full(len(here), item[k]))
            offsets.append(np.full(len(here), offset[k]))
    if not places:
        return none, none, none
    return np.concatenate(items), np.concatenate(offsets), np.concatenate(places)


def _matches(tests: TestSuffixes, texts: list[bytes | None]) -> list[tuple[int, list]]:
    """Word count and longest verbatim matches (item, item start, start, words) of each text."""
    get = tests.numbers.get
    rows, counts, begins, total = [], [], [], 0
    for text in texts:
        words = alnum_words(text)
        rows.append(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)))
        counts.append(len(words))
        begins.append(total)
        total += len(words) + 1
    shard = np.zeros(total, np.uint32)
    for begin, row in zip(begins, rows, strict=True):
        shard[begin : begin + len(row)] = row
    item, offset, place = _hits(tests, shard)
    found: list[list] = [[] for _ in texts]
    if len(item):
        size = {}
        for length, _, items, _ in tests.by_length:
            size |= dict.fromkeys(items.tolist(), length)
        order = np.lexsort((place, place - offset, item))
        item, offset, place = item[order], offset[order], place[order]
        doc = np.searchsorted(begins, place, "right") - 1
        new = np.ones(len(item), bool)
        new[1:] = (np.diff(item) != 0) | (np.diff(place - offset) != 0) | (np.diff(place) != 1) | (np.diff(doc) != 0)
        heads = np.flatnonzero(new)
        for head, n in zip(heads, np.diff(np.append(heads, len(item))), strict=True):
            k = int(item[head])
            d = int(doc[head])
            found[d].append((tests.ids[k], int(offset[head]), int(place[head]) - begins[d], int(n) + size[k] - 1))
    return list(zip(counts, found, strict=True))


def _covered(spans: list[tuple]) -> int:
    covered, reach = 0, 0
    for start, n in sorted((s, n) for _, _, s, n in spans):
        covered += max(0, start + n - max(start, reach))
        reach = max(reach, start + n)
    return covered


def _item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[bool, list[tuple[str | None, bytes | None]]]]:
    """(whether it is the last one, items) of blocks of about ``block_words`` words, each fetched when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * block_words)))  # two bytes a word at least, with its separator
    part = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield k == n - 1, [(r.item_id, r.text.encode() if r.text is not None else None) for r in part.where(F.col("part") == k).orderBy("item_id", "text").collect()]


def suffix_matches(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit and all longest verbatim matches."""
    out, steps, space = docs, [], None
    base = docs.columns if keep is None else keep
    for last, items in _item_blocks(benchmark, block_words):
        tests = TestSuffixes(items, window)

        def compute(texts, tests=tests):
            for n, spans in _matches(tests, texts):
                yield n, _covered(spans), spans

        steps.append(fresh_name(out, f"found{len(steps)}"))
        out = with_struct(out, steps[-1], FOUND, compute, keep=[*(base if last else docs.columns), *steps[:-1]])
        if not last:
            space = space or Workspace(docs.sparkSession)
            out = space.save(out, steps[-1])
            space.drop(*steps[:-1])
    if len(steps) == 1:
        return out.select(*[out[c] for c in base], out[steps[0]].alias(name))
    spans = F.flatten(F.array(*[out[s]["matches"] for s in steps]))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["doc_start"].alias("s"), (x["doc_start"] + x["n_words"]).alias("e"))))
    hit = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(x["s"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["e"]).alias("reach")),
        lambda a: a["n"],
    )
    return out.select(*[out[c] for c in base], F.struct(out[steps[0]]["n_words"].alias("n_words"), hit.alias("n_hit"), spans.alias("matches")).alias(name))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    name = fresh_name(docs, "matches")
    found = suffix_matches(docs, benchmark, name, window)
    return found.where(found[name]["n_hit"] == 0).drop(name)
