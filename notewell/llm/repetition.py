"""Quality rules on repetition, from suffix arrays over the words of each document.

Prefix doubling ranks the suffixes of every document of a block together (words are numbered so
that no symbol crosses documents); only suffixes whose prefix so far repeats stay active, so
natural prose is done after two or three levels. Neighbours in the array compare level by level
for their longest common prefix, a stack walks the LCP intervals, and the left-diverse ones are
the maximal repeated substrings. The union of their spans is the covered part of the document:
it equals the union over suffixes of the longest prefix shared with a neighbour.

A document is kept when its repeats of at least ``min_words`` words cover at most
``max_covered`` percent of its words and the longest has at most ``max_longest`` words, besides
the base rules. Everything is local to a row: one scan, no shuffle.

Defined results: a null or empty text has no words, fails the base rule on length and is not
kept; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from notewell.llm.common import fresh_name, space_words, with_struct

MIN_WORDS = 8
MAX_COVERED = 40
MAX_LONGEST = 100
BASE_MIN_WORDS = 50
BASE_MAX_REPEATED = 50

RULES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, n_repeats bigint, n_covered bigint, longest_repeat bigint, kept boolean"
)

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_DROP = {"symbols": bytes(set(range(256)) - set(_SYMBOLS)), "word_chars": _SPACE + _CONTINUATION}
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if _HAS_WORD.search(line)]
    return len(lines) - len(set(lines))


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, the first index of each place's group, and each place's group size."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(heads, len(keys)))
    return order, np.repeat(heads, sizes), np.repeat(sizes, sizes)


class SuffixRanks:
    """Ranks of the suffixes of a block by prefix doubling; ``levels`` keeps (length, ranks)."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        order, heads, sizes = _ranked(symbols)
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = heads
        self.n, self.active, self.levels = n, np.sort(order[sizes > 1]), [(1, rank)]

    def rank_after(self, length: int, step: int) -> np.ndarray:
        """Of the active suffixes, the rank of the suffix ``step`` words on."""
        return self.levels[-1][1][np.minimum(self.active + step, self.n)]

    def grow(self) -> None:
        """Double the compared length; suffixes that became unique leave."""
        length, rank = self.levels[-1]
        at = self.active
        after = self.rank_after(length, length)
        order = np.lexsort((after, rank[at]))
        here, first, second = at[order], rank[at][order], after[order]
        new_group = np.append(True, first[1:] != first[:-1])
        new = new_group | np.append(True, second[1:] != second[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(here)))
        starts = np.flatnonzero(new_group)
        base = np.repeat(starts, np.diff(np.append(starts, len(here))))
        grown = rank.copy()
        grown[here] = first + (np.repeat(heads, sizes) - base)
        self.active = np.sort(here[np.repeat(sizes, sizes) > 1])
        self.levels.append((2 * length, grown))

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Longest common prefix of pairs of different suffixes."""
        out = np.zeros(len(one), np.int64)
        for length, rank in reversed(self.levels):
            same = rank[np.minimum(one + out, self.n)] == rank[np.minimum(other + out, self.n)]
            out += length * same
        return out


def repeated_in_windows(ranks: SuffixRanks, doc: np.ndarray, size: int = 3) -> np.ndarray:
    """Mask of words in windows of three words that occur twice or more in their document."""
    hit = np.zeros(ranks.n + 1, np.int64)
    at = ranks.active[ranks.active + size - 1 < ranks.n]
    at = at[doc[at + size - 1] == doc[at]]
    if len(at):
        pair, word = ranks.levels[-1][1], ranks.levels[0][1]
        _, number, count = np.unique(pair[at] * (ranks.n + 1) + word[at + size - 1], return_inverse=True, return_counts=True)
        at = at[count[number] > 1]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
    return np.cumsum(hit[:-1]) > 0


def maximal_repeats(suffixes: np.ndarray, shared: np.ndarray, before: np.ndarray, floor: int) -> list[tuple[int, int, int]]:
    """LCP intervals of at least ``floor`` words that aren't all preceded by one word.

    suffixes: in array order; shared: common prefix with the previous one (0 between documents);
    before: the symbol before each. Gives (length, first, last) with places in the array.
    """
    differs = np.zeros(len(suffixes), np.int64)
    differs[1:] = np.cumsum(before[1:] != before[:-1])
    found, stack = [], []
    for i, length in enumerate([*shared[1:].tolist(), 0], start=1):
        left = i - 1
        while stack and stack[-1][0] > length:
            depth, left = stack.pop()
            if depth >= floor and differs[i - 1] > differs[left]:
                found.append((depth, left, i - 1))
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, left))
    return found


def _judge(texts: list[bytes | None], min_words: int, max_covered: int, max_longest: int) -> list[tuple]:
    numbers: dict[bytes, int] = {}
    rows = [space_words(t) for t in texts]
    counts = np.array([len(r) for r in rows], np.int64)
    begins = np.cumsum(counts) - counts
    n = int(counts.sum())
    doc = np.repeat(np.arange(len(rows)), counts)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for r in rows for w in r), np.int64, n)
    ranks = SuffixRanks(words + doc * len(numbers))

    def by_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=len(rows))

    ranks.grow()
    repeated = by_doc(repeated_in_windows(ranks, doc))
    while len(ranks.active) and 2 * ranks.levels[-1][0] <= min_words:
        ranks.grow()
    seeds = ranks.active
    while len(ranks.active):
        ranks.grow()
    final = ranks.levels[-1][1]
    suffixes = seeds[np.argsort(final[seeds])]
    covered, longest, repeats = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    if len(suffixes):
        shared = np.zeros(len(suffixes), np.int64)
        near = np.flatnonzero(doc[suffixes[1:]] == doc[suffixes[:-1]]) + 1
        shared[near] = ranks.common(suffixes[near], suffixes[near - 1])
        # a word number before each suffix; document starts differ from everything
        before = np.where(suffixes == begins[doc[suffixes]], -1 - np.arange(len(suffixes)), words[np.maximum(suffixes - 1, 0)])
        for _, left, _ in maximal_repeats(suffixes, shared, before, min_words):
            repeats[doc[suffixes[left]]] += 1
        reach = np.maximum(shared, np.append(shared[1:], 0))
        long = reach >= min_words
        np.maximum.at(longest, doc[suffixes[long]], reach[long])
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, suffixes[long], 1)
        np.add.at(marks, suffixes[long] + reach[long], -1)
        covered = by_doc(np.cumsum(marks[:-1]) > 0)
    out = []
    for k, text in enumerate(texts):
        text, total = text or b"", int(counts[k])
        failed = total < BASE_MIN_WORDS or 100 * int(repeated[k]) > BASE_MAX_REPEATED * total
        kept = not failed and 100 * int(covered[k]) <= max_covered * total and int(longest[k]) <= max_longest
        out.append((
            total, len(text.translate(None, _DROP["word_chars"])), len(text.translate(None, _DROP["symbols"])), _duplicate_lines(text), int(repeated[k]),
            failed, int(repeats[k]), int(covered[k]), int(longest[k]), kept,
        ))
    return out


def repetition_rules(
    docs: DataFrame, name: str, min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with a struct column ``name`` of the base counts, the repeats and the verdict."""
    return with_struct(docs, name, RULES, lambda texts: _judge(texts, min_words, max_covered, max_longest), keep=keep)


def passing(docs: DataFrame, **limits: int) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    name = fresh_name(docs, "rules")
    judged = repetition_rules(docs, name, **limits)
    return judged.where(judged[name]["kept"]).drop(name)
