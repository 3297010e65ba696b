"""Spelling variants: words one code point apart, found with forward and backward word automata.

Words are counted over all texts, then every two words at distance one are met through a part that
they share. Such a pair has one place of error, its common prefix; if that is at least half of the
shorter word, the pair shares its first half exactly, else its second half. So each word goes to
the group of its first and the group of its last ``SHARED`` code points. In a group of prefixes a
minimal acyclic automaton of the words, in a group of suffixes one of the reversed words, matches
half of each word exactly and completes the rest with one error. Arcs carry the number of words
that sort before, so a path spells the perfect-hash number of its word, and numbers give counts.
A pair counts in the group of its place of error alone, which is what removes duplicates.

A group of over ``GROUP_WORDS`` words is divided: words are set apart by the length of the pair's
shorter word, and the interval of places of error is halved, again and again; each part shares all
that lies outside of its interval. Parts of one place are bounded by the alphabet (words of a part
differ in two code points at most). So no task holds more than a group, however frequent
a beginning or an ending is, and no pair is lost.

Jobs: one counting scan (counts are combined in tasks before the shuffle), one pass over grouped
words, roots by pointer jumping over the words that have a form.

Defined results: null and empty texts have no words; a null doc_id deletes no code point; repeated
rows count as often as they stand there; a table without words gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace

MIN_LENGTH = 7
MIN_COUNT = 2
FORM_FACTOR = 10
#: A word loses a code point if its hash is divisible by this.
DROP_SHARE = 31
#: Code points by which words are grouped first: half of the shortest words.
SHARED = MIN_LENGTH // 2
GROUP_WORDS = 8_192
HELD_WORDS = 400_000

_LETTERS = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")


# ------------------------------------------------------------------ counts
def text_words(text: bytes | None) -> list[bytes]:
    """Runs of at least MIN_LENGTH letters, lower-case in A-Z."""
    return [w for w in _LETTERS.findall(text.lower()) if len(w) - w.count(b"\xc3") >= MIN_LENGTH] if text else []


def spelled(word: bytes, seed: int) -> bytes:
    """The word, less one code point if its hash, begun by ``seed``, says so."""
    h = zlib.crc32(word, seed)
    if h % DROP_SHARE:
        return word
    chars = word.decode()
    at = h % len(chars)
    return (chars[:at] + chars[at + 1 :]).encode()


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all texts, as ``spelled`` in each document."""

    def batch_of(counts: dict[bytes, int]) -> pa.RecordBatch:
        kept = [w for w in counts if len(w) - w.count(b"\xc3") >= MIN_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in kept], pa.string()), pa.array([counts[w] for w in kept], pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[bytes, int] = {}
                for word in text_words(text):
                    own[word] = own.get(word, 0) + 1
                if key is not None:
                    seed = zlib.crc32(f"{key}:".encode())
                    for word, n in own.items():
                        word = spelled(word, seed)
                        held[word] = held.get(word, 0) + n
                else:
                    for word, n in own.items():
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield batch_of(held)
                    held = {}
        yield batch_of(held)

    fed = docs.select(docs["doc_id"].cast("string").alias("key"), docs["text"].cast("string").cast("binary").alias("fed"))
    return fed.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ automata
class WordAutomaton:
    """Minimal acyclic automaton of sorted words; paths add up to the words' numbers.

    ``arcs[state]`` maps a code point to (state, words of the state that sort before that arc).
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._below: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, [], []]]  # open states: final, labels, targets
        last = ""
        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            self._close(path, known, same)
            for c in word[same:]:
                path[-1][1].append(c)
                path.append([False, [], []])
            path[-1][0] = True
            last = word
        self._close(path, known, 0)
        self.root = self._state(path[0], known)

    def _close(self, path: list[list], known: dict[tuple, int], depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop(), known)
            path[-1][2].append(state)

    def _state(self, opened: list, known: dict[tuple, int]) -> int:
        final, labels, targets = opened
        key = (final, "".join(labels), tuple(targets))
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.arcs)
            arcs, below = {}, int(final)
            for label, target in zip(labels, targets, strict=True):
                arcs[label] = (target, below)
                below += self._below[target]
            self.arcs.append(arcs)
            self.final.append(final)
            self._below.append(below)
        return state

    def walk(self, word: str, at: int, state: int, number: int) -> tuple[int, int] | None:
        """(state, number) after ``word[at:]``, or None."""
        arcs = self.arcs
        for c in word[at:]:
            step = arcs[state].get(c)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with ``word[:exact]`` and differ by one error after it."""
        begun = self.walk(word[:exact], 0, self.root, 0)
        found: set[int] = set()
        if begun is None:
            return found
        arcs, final, size = self.arcs, self.final, len(word)
        state, number = begun
        for i in range(exact, size + 1):
            out = arcs[state]
            c = word[i] if i < size else None
            after = word[i + 1] if i + 1 < size else None
            if c is not None and (end := self.walk(word, i + 1, state, number)) and final[end[0]]:  # without c
                found.add(end[1])
            for label, (target, before) in out.items():
                below = arcs[target]
                if c is not None and label != c and (after in below if after is not None else final[target]) and (end := self.walk(word, i + 1, target, number + before)) and final[end[0]]:
                    found.add(end[1])  # another code point for c
                if (c in below if c is not None else final[target]) and (end := self.walk(word, i, target, number + before)) and final[end[0]]:
                    found.add(end[1])  # one before c
            step = out.get(c) if c is not None else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def _common(one: str, other: str) -> int:
    same = 0
    for x, y in zip(one, other, strict=False):
        if x != y:
            break
        same += 1
    return same


def near_in_group(words: list[str], counts: list[int], low: int | None, high: int | None, length: int | None, forward: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count, that word) of the words of a group with near words in it.

    Pairs count if their common prefix lies in [low, high), and, where ``length`` is set, their
    shorter word has it. Without bounds the prefix decides by the half of the shorter word.
    """
    turned = sorted((w if forward else w[::-1], n) for w, n in zip(words, counts, strict=True))
    automaton = WordAutomaton([w for w, _ in turned])
    for word, _ in turned:
        size = len(word)
        shorter = size - 1 if length is None else length
        if low is None:
            exact = shorter // 2 if forward else shorter - shorter // 2
        else:
            exact = low if forward else max(0, length - high)
        best, near = None, 0
        for k in automaton.near(word, exact):
            other, n = turned[k]
            least = min(size, len(other))
            if length is not None and least != length:
                continue
            one, two = (word, other) if forward else (word[::-1], other[::-1])
            place = _common(one, two)
            if low is None:
                if (place >= least // 2) != forward:
                    continue
            elif not low <= place < high:
                continue
            near += 1
            if best is None or (-n, two) < best:
                best = (-n, two)
        if best:
            yield (word if forward else word[::-1]), near, -best[0], best[1]


# ------------------------------------------------------------------ groups
GROUP = "struct<forward:boolean,length:int,low:int,high:int>"


def _first_groups(words: DataFrame) -> DataFrame:
    whole = lambda forward: F.struct(F.lit(forward).alias("forward"), *[F.lit(None).cast("int").alias(c) for c in ("length", "low", "high")])
    keyed = words.select("word", "n", F.explode(F.array(whole(True), whole(False))).alias("part"))
    return keyed.withColumn("key", F.when(F.col("part.forward"), F.concat(F.substring("word", 1, SHARED), F.lit("-"))).otherwise(F.concat(F.lit("-"), F.substring("word", -SHARED, SHARED))))


def _divided(rows: DataFrame) -> DataFrame:
    """The rows of large groups in the halves of their intervals."""
    chars = F.char_length("word")
    lengths = F.explode(F.when(F.col("part.length").isNull(), F.array(chars, chars - 1)).otherwise(F.array("part.length")))
    apart = rows.select("word", "n", "part", lengths.alias("length")).where(F.col("length") >= MIN_LENGTH)
    half = (F.col("length") / 2).cast("int")
    bounded = apart.select(
        "word", "n", "length", F.col("part.forward").alias("forward"),
        F.coalesce("part.low", F.when(F.col("part.forward"), half).otherwise(0)).alias("low"), F.coalesce("part.high", F.when(F.col("part.forward"), F.col("length") + 1).otherwise(half)).alias("high"),
    )
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    part = lambda low, high: F.struct("forward", "length", low.alias("low"), high.alias("high"))
    parts = F.when(F.col("high") - F.col("low") > 1, F.array(part(F.col("low"), middle), part(middle, F.col("high")))).otherwise(F.array(part(F.col("low"), F.col("high"))))
    split = bounded.select("word", "n", F.explode(parts).alias("part"))
    ending = F.greatest(F.col("part.length") - F.col("part.high"), F.lit(0))
    key = F.concat_ws(" ", "part.forward", "part.length", "part.low", "part.high", F.substring(F.col("word"), F.lit(1), F.col("part.low")), F.when(ending > 0, F.substring(F.col("word"), -ending, ending)).otherwise(""))
    return split.withColumn("key", key)


def grouped_words(words: DataFrame, space: Workspace, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, n, part, key) of every group; groups over ``limit`` words are divided while they can be."""
    level, waiting, whole = 0, _first_groups(words), []
    while True:
        dividable = F.col("part.high").isNull() | (F.col("part.high") - F.col("part.low") > 1)
        sizes = waiting.where(dividable).groupBy("key").count().where(F.col("count") > limit).select("key")
        large = space.save(sizes, f"large-{level}")
        if large.isEmpty():
            return waiting if not whole else _union([*whole, waiting])
        whole.append(waiting.join(large, "key", "left_anti").select("word", "n", "part", "key"))
        waiting = space.save(_divided(waiting.join(large, "key", "left_semi")), f"divided-{level}")
        level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_words(words: DataFrame, space: Workspace, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best: least_n and form) of the words that have near words."""

    def run(batches):
        rows = ((k, w, n, p) for b in batches for k, w, n, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            held = list(group)
            part = held[0][3]
            found = list(near_in_group([r[1] for r in held], [r[2] for r in held], part["low"], part["high"], part["length"], part["forward"]))
            if found:
                names = ["word", "near", "n", "form"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    rows = grouped_words(words, space, limit).select("key", "word", "n", "part")
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near bigint, n bigint, form string")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best"))


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """(word, root) of every word of (word, form): forms followed to the last, by pointer jumping."""
    held = space.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        beyond = held.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = held.join(beyond, F.col("root") == F.col("at"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        made = space.save(moved, f"roots-{turn}")
        space.drop(f"roots-{turn - 1}")
        held = made.select("word", "root")
        if made.where("moved").isEmpty():
            return held


def variants(docs: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    space = Workspace(docs.sparkSession)
    words = space.save(word_counts(docs), "words")
    near = words.join(near_words(words, space, limit), "word", "left")
    is_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    judged = space.save(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "judged"
    )
    ends = roots(judged.where("form is not null"), space)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
