"""Secret scans with automata inferred from labelled credentials.

The base patterns label credentials in the corpus (password-like assignments, access keys, hex
strings). For each label all distinct values become a prefix tree, counted on Spark by node. Its
symbols are the punctuation marks themselves and one for any letter or digit; states keep the
letters and digits they are left by. Nodes that fewer than one in ``TOLD`` values pass, and all from symbol
``TOLD_LENGTHS`` on, are told apart by their depth only, so a tree has a bounded number of states and
still counts every symbol of every value. Two states merge (ALERGIA) if their ends, symbols and character
classes, and those of all states below them, agree within a Hoeffding bound. Only states that
``SUPPORT`` values pass can be found compatible, so that lack of evidence is not taken for agreement and fixed
lengths and prefixes stay known. A state's characters are smoothed towards those of the whole
automaton; a length or mark that no path has is impossible.

The automata then score every other run of the characters of values, of the shortest base length
or more. A run is added to the base spans if its likelihood per symbol lies within the range of
the labelled values, and its ratio to a background model of the corpus' own words is over that of ``WORDS_BELOW`` of the words (all but one occurrence where words are few). All
words of the corpus count, in the background and for the bound. For the range every value is scored with its own counts taken
away, so that all values make both the format and its bounds (which states merge is decided with all values; a
single value has no others and is scored as it is). Each automaton keeps its recall on values scored so
and the share of words that it would add.

Jobs: one scan that labels values and counts the words' pairs of characters; small jobs over the distinct
values; one scan that scores words, of which only those likelier in a format than among words are
counted by score; one scan that scores candidates. The driver holds trees and sums of bounded size, never
the values themselves.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by
one; a label without values infers no automaton and adds no span; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace, blocks, fresh_name, with_struct

KINDS = ("assign", "access", "hex")
#: A node of a prefix tree is a state of its own if one in so many values passes it.
TOLD = 200
#: The share of the words' occurrences that stays below the bound.
WORDS_BELOW = 0.999
SUPPORT = 10
HELD_SHARE = 5
ALPHA = 0.05
SLACK = 0.25
#: Examples that a state's own characters must outweigh.
PRIOR = 5.0
#: Lengths and depths up to this are told apart; an automaton with longer paths takes all lengths from its least on.
TOLD_LENGTHS = 512
#: What a task holds at once: rows it makes, and bytes of values whose prefixes are counted together.
BATCH_ROWS = 20_000
TREE_BYTES = 200_000
PLACEHOLDER = "[SECRET]"

# The base patterns; matches that are too short are dropped.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}

# runs of the training alphabet
MIN_CANDIDATE = min(MIN_LENGTH.values())
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)
_CANDIDATE_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_TO_CANDIDATES = bytes(b if b in _CANDIDATE_BYTES else 0x20 for b in range(256))
# character classes: digits, a-f, g-z, A-F, G-Z; marks stand for themselves
_CLASS_OF = {b: 0 for b in b"0123456789"} | {b: 1 for b in b"abcdef"} | {b: 2 for b in b"ghijklmnopqrstuvwxyz"} | {b: 3 for b in b"ABCDEF"} | {b: 4 for b in b"GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_SIZES = [sum(c == k for c in _CLASS_OF.values()) for k in range(5)]
ANY = ord("x")
_COARSE = bytes(ANY if b in _CLASS_OF else b for b in range(256))


# kinds of characters in pairs: the classes, any mark, and 6 for the end of a word
_MARKS = [b for b in _CANDIDATE_BYTES if b not in _CLASS_OF]
_PAIR_KINDS = np.full(256, 6)
_PAIR_KINDS[list(_CLASS_OF)] = list(_CLASS_OF.values())
_PAIR_KINDS[_MARKS] = 5

END = 0
_ROOT = b""


@dataclass(slots=True)
class State:
    passed: int = 0
    ended: int = 0
    arcs: dict[int, int] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    chars: Counter = field(default_factory=Counter)
    classes: list[int] = field(default_factory=lambda: [0] * len(_CLASS_SIZES))

    def leave(self, c: int, n: int) -> int:
        """Count ``n`` values that go on with character ``c``; its symbol."""
        symbol = _COARSE[c]
        self.passed += n
        self.used[symbol] = self.used.get(symbol, 0) + n
        if c in _CLASS_OF:
            self.chars[c] += n
            self.classes[_CLASS_OF[c]] += n
        return symbol

    def end(self, n: int) -> None:
        self.passed += n
        self.ended += n

    def commonest(self) -> int | None:
        return min(self.chars, key=lambda c: (-self.chars[c], c), default=None)


@dataclass
class Tree:
    """A prefix tree: nodes with (character, n, child) each, and by depth (character, n) of those too rare to be told apart."""

    nodes: dict[bytes, tuple[int, list[tuple[int, int, bytes | None]]]] = field(default_factory=dict)
    pooled: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def states(self) -> list[State]:
        keys = [_ROOT, *(k for k in self.nodes if k != _ROOT)]
        number = {k: i for i, k in enumerate(keys)}
        at_depth = {d: len(keys) + i for i, d in enumerate(self.pooled)}
        made = [State() for _ in range(len(keys) + len(at_depth))]
        for key in self.nodes:
            state, (depth, left) = made[number[key]], self.nodes[key]
            for c, n, child in left:
                if c == END:
                    state.end(n)
                else:
                    state.arcs[state.leave(c, n)] = number[child] if child in number else at_depth[depth + 1]
        for depth, left in self.pooled.items():
            state = made[at_depth[depth]]
            for c, n in left:
                if c == END:
                    state.end(n)
                else:
                    state.arcs[state.leave(c, n)] = at_depth[min(depth + 1, TOLD_LENGTHS)]
        return made


def prefix_counts(values: Iterable[bytes]) -> Counter:
    """Values by (node, depth, character, child); END is the character at ends, and nodes at TOLD_LENGTHS are one."""
    children, counts = {}, Counter()
    for value in values:
        node, shape = _ROOT, value[:TOLD_LENGTHS].translate(_COARSE)
        for depth, c in enumerate(value[:TOLD_LENGTHS]):
            step = (node, shape[depth])
            child = children.get(step)
            if child is None:
                child = children[step] = hashlib.blake2b(node + shape[depth : depth + 1], digest_size=16).digest()
            counts[node, depth, c, child] += 1
            node = child
        if len(value) < TOLD_LENGTHS:
            counts[node, len(value), END, None] += 1
        else:
            for c, n in Counter(value[TOLD_LENGTHS:]).items():
                counts[_ROOT, TOLD_LENGTHS, c, None] += n
            counts[_ROOT, TOLD_LENGTHS, END, None] += 1
    return counts


def prefix_tree(values: list[bytes]) -> Tree:
    """The tree of a list of values, as ``prefix_trees`` makes it of a table."""
    found, tree = {}, Tree()
    for (node, depth, c, child), n in prefix_counts(values).items():
        found.setdefault((node, depth), []).append((c, n, child))
    for (node, depth), left in found.items():
        if depth < TOLD_LENGTHS and sum(n for _, n, _ in left) * TOLD >= len(values):
            tree.nodes[node] = (depth, left)
        else:
            tree.pooled.setdefault(depth, []).extend((c, n) for c, n, _ in left)
    return tree


def pair_counts(words: list[bytes]) -> np.ndarray:
    """How often a kind of character follows another in words, as kind * 7 + next kind; 6 stands before and after a word."""
    if not words:
        return np.zeros(49, np.int64)
    kinds = _PAIR_KINDS[np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)]
    return np.bincount(kinds[:-1] * 7 + kinds[1:], minlength=49)


class Background:
    """Characters of the corpus' words after the class of the one before, with one added to each."""

    def __init__(self, pairs: np.ndarray) -> None:
        follow = np.asarray(pairs).reshape(7, 7) + 1.0
        logs = np.log2(follow / follow.sum(axis=1, keepdims=True) / np.array([*_CLASS_SIZES, len(_MARKS), 1]))
        self.kinds, self.logs = _PAIR_KINDS.tolist(), logs.tolist()
        self.n_words = int(np.asarray(pairs).reshape(7, 7)[6].sum())

    def total(self, value: bytes) -> float:
        before, out = 6, 0.0
        for c in value:
            kind = self.kinds[c]
            out += self.logs[before][kind]
            before = kind
        return out + self.logs[before][6]


def is_held(value: bytes) -> bool:
    """Whether a value is of the share that tests hold out; the formats themselves learn from all."""
    return zlib.crc32(value) % HELD_SHARE == 0


def _shares(classes: np.ndarray) -> np.ndarray:
    return (classes + 0.01) / (classes + 0.01).sum()


def _char_log(kind: int, n: int, of_kind: int, seen: int, pooled: np.ndarray) -> float:
    """Log2 probability of a letter or digit counted ``n`` times in a state, among ``of_kind`` of its class and ``seen`` of all."""
    of_class = (of_kind + PRIOR * pooled[kind]) / (seen + PRIOR)
    in_class = (n + PRIOR / _CLASS_SIZES[kind]) / (of_kind + PRIOR)
    return math.log2(of_class * in_class)


class FormatAutomaton:
    """Probabilistic automaton of a credential format, inferred by compatible state merging."""

    def __init__(self, examples: list[bytes], words: list[tuple[bytes, int]] = (), alpha: float = ALPHA, slack: float = SLACK, support: int = SUPPORT) -> None:
        self._infer(prefix_tree(examples), alpha, support)
        self.background = Background(sum((n * pair_counts([w]) for w, n in words), np.zeros(49, np.int64)))
        scored = [self.without(e) if len(examples) > 1 else self.likelihood(e) for e in examples]
        self._bound([x for x in scored if x > -math.inf], max(map(self.likelihood, examples)), slack)
        self.least_ratio = 0.0
        self._calibrate(list(words))
        self.recall = sum(self.low <= x <= self.high and self._over_words(e, x) > self.least_ratio for e, x in zip(examples, scored, strict=True)) / len(examples)
        self.added_words = sum(n for w, n in words if self.accepts(w)) / max(1, sum(n for _, n in words))

    @classmethod
    def of_tree(cls, tree: Tree, alpha: float = ALPHA, support: int = SUPPORT) -> FormatAutomaton:
        """An automaton without bounds and background."""
        made = object.__new__(cls)
        made._infer(tree, alpha, support)
        return made

    def _infer(self, tree: Tree, alpha: float, support: int) -> None:
        self.alpha, self.support = math.sqrt(0.5 * math.log(2 / alpha)), support
        self.states, self.differing = tree.states(), set()
        self.folded = list(range(len(self.states)))
        self._merge()
        self._weigh()
        self.lengths, self.unbounded = self._lengths()

    def _bound(self, scores: list[float], trained: float, slack: float = SLACK) -> None:
        """The range of what values score without their own counts, which end here; values may stand elsewhere too, so with them they bound what is too likely."""
        self.low, self.high = (min(scores) - slack, max(*scores, trained) + slack) if scores else (math.inf, -math.inf)
        self.counts = None

    def _differ(self, count: int, total: int, other: int, other_total: int) -> bool:
        return abs(count / total - other / other_total) > self.alpha * (1 / math.sqrt(total) + 1 / math.sqrt(other_total))

    def _now(self, state: int) -> int:
        """The state that a state has been folded into."""
        while self.folded[state] != state:
            self.folded[state] = state = self.folded[self.folded[state]]
        return state

    def _compatible(self, red: int, blue: int) -> bool:
        walked = [(red, blue, -1)]  # pairs below the first, with the place of the pair above
        seen, todo = {(red, blue)}, [0]
        while todo:
            at = todo.pop()
            a, b, _ = walked[at]
            one, two = self.states[a], self.states[b]
            if (a, b) in self.differing or self._states_differ(one, two):
                while at >= 0:  # what is above a pair that differs does too, until states are folded
                    self.differing.add(walked[at][:2])
                    at = walked[at][2]
                return False
            for symbol, target in two.arcs.items():
                if symbol in one.arcs:
                    pair = self._now(one.arcs[symbol]), self._now(target)
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        todo.append(len(walked))
                        walked.append((*pair, at))
        return True

    def _states_differ(self, one: State, two: State) -> bool:
        if self._differ(one.ended, one.passed, two.ended, two.passed):
            return True
        if any(self._differ(one.used.get(x, 0), one.passed, two.used.get(x, 0), two.passed) for x in one.used.keys() | two.used.keys()):
            return True
        if any(self._differ(a, one.passed, b, two.passed) for a, b in zip(one.classes, two.classes, strict=True)):
            return True
        return any(self._differ(one.chars[c], one.passed, two.chars[c], two.passed) for c in {one.commonest(), two.commonest()} - {None})

    def _fold(self, red: int, blue: int) -> None:
        """Make one state of two, and of all that their arcs lead to by the same symbols."""
        self.differing.clear()
        pairs = [(red, blue)]
        while pairs:
            a, b = map(self._now, pairs.pop())
            if a == b:
                continue
            one, two = self.states[a], self.states[b]
            self.folded[b] = a
            one.passed += two.passed
            one.ended += two.ended
            one.chars.update(two.chars)
            one.classes = [x + y for x, y in zip(one.classes, two.classes, strict=True)]
            for symbol, target in two.arcs.items():
                one.used[symbol] = one.used.get(symbol, 0) + two.used[symbol]
                if symbol in one.arcs:
                    pairs.append((one.arcs[symbol], target))
                else:
                    one.arcs[symbol] = target

    def _merge(self) -> None:
        red, waiting = {0: None}, deque((0, s) for s in sorted(self.states[0].arcs))
        while waiting:
            parent, symbol = waiting.popleft()
            blue = self._now(self.states[self._now(parent)].arcs[symbol])
            if blue in red or self.states[blue].passed < self.support:
                continue  # too few values to tell: the state stays as the tree has it
            for state in red:
                if self._compatible(state, blue):
                    self._fold(state, blue)
                    red = dict.fromkeys(map(self._now, red))
                    # folding can give red states arcs to states not looked at yet
                    asked = set(waiting)
                    waiting.extend((r, s) for r in red for s in sorted(self.states[r].arcs) if self._now(self.states[r].arcs[s]) not in red and (r, s) not in asked)
                    break
            else:
                red[blue] = None
                waiting.extend((blue, s) for s in sorted(self.states[blue].arcs))

    def _weigh(self) -> None:
        """Log2 probabilities of arcs, ends and characters of all states that can be reached."""
        reached, todo = {0: 0}, [0]
        while todo:
            for target in map(self._now, self.states[todo.pop()].arcs.values()):
                if target not in reached:
                    reached[target] = len(reached)
                    todo.append(target)
        self.counts = [self.states[s] for s in reached]
        self.classes = sum((np.array(s.classes) for s in self.counts), np.zeros(len(_CLASS_SIZES)))
        pooled = _shares(self.classes)
        self.size, self.steps, self.ends = len(reached), [None] * len(reached), [-math.inf] * len(reached)
        for old, new in reached.items():
            state, step = self.states[old], {}
            for symbol, target in state.arcs.items():
                share = math.log2(state.used[symbol] / state.passed)
                if symbol != ANY:
                    step[symbol] = (share, reached[self._now(target)])
                    continue
                seen, classes = sum(state.classes), state.classes
                for c, kind in _CLASS_OF.items():
                    step[c] = (share + _char_log(kind, state.chars[c], classes[kind], seen, pooled), reached[self._now(target)])
            self.steps[new] = step
            if state.ended:
                self.ends[new] = math.log2(state.ended / state.passed)
        del self.states, self.differing, self.folded

    def _lengths(self) -> tuple[frozenset[int], bool]:
        """Lengths of the values the automaton can make, and whether it makes longer ones than TOLD_LENGTHS."""
        at, lengths = {0}, set()
        for length in range(TOLD_LENGTHS + 1):
            if any(self.ends[s] > -math.inf for s in at):
                lengths.add(length)
            at = {target for s in at for _, target in self.steps[s].values()}
        return frozenset(lengths), bool(at)

    def _total(self, value: bytes) -> float:
        state, total = 0, 0.0
        for c in value:
            step = self.steps[state].get(c)
            if step is None:
                return -math.inf
            total += step[0]
            state = step[1]
        return total + self.ends[state]

    def likelihood(self, value: bytes) -> float:
        """log2 likelihood per symbol, the end included; minus infinity for an impossible value."""
        return self._total(value) / (len(value) + 1)

    def without(self, value: bytes) -> float:
        """``likelihood`` of a value that was learned from, as the others alone make it: its own counts are taken away."""
        path = [0]
        for c in value:
            path.append(self.steps[path[-1]][c][1])
        passed, used = Counter(path), Counter(zip(path, value.translate(_COARSE)))
        chars, classes, own = Counter(zip(path, value)), Counter(), np.zeros(len(_CLASS_SIZES))
        for (s, c), n in chars.items():
            if c in _CLASS_OF:
                classes[s, _CLASS_OF[c]] += n
                own[_CLASS_OF[c]] += n
        pooled, total = _shares(self.classes - own), 0.0
        for s, c in zip(path, value):
            state, symbol = self.counts[s], _COARSE[c]
            n = state.used[symbol] - used[s, symbol]
            if not n:
                return -math.inf
            total += math.log2(n / (state.passed - passed[s]))
            if symbol == ANY:
                kind = _CLASS_OF[c]
                total += _char_log(kind, state.chars[c] - chars[s, c], state.classes[kind] - classes[s, kind], n, pooled)
        state = self.counts[path[-1]]
        return (total + math.log2((state.ended - 1) / (state.passed - passed[path[-1]]))) / (len(value) + 1) if state.ended > 1 else -math.inf

    def ratio(self, value: bytes) -> float:
        """How much likelier per symbol the value is in this format than among the corpus' words."""
        return self._over_words(value, self.likelihood(value))

    def _over_words(self, value: bytes, likely: float) -> float:
        return likely if likely == -math.inf else likely - self.background.total(value) / (len(value) + 1)

    def _calibrate(self, words: list[tuple[bytes, int]], below: float = WORDS_BELOW) -> None:
        """Raise the least ratio over that of ``below`` of the words' occurrences."""
        left = _left(sum(n for _, n in words), below)
        for score, n in sorted(((self.ratio(w), n) for w, n in words), reverse=True):
            left -= n
            if left < 0:
                self.least_ratio = max(self.least_ratio, math.nextafter(score, math.inf))
                break

    def possible(self, length: int) -> bool:
        return length in self.lengths or (self.unbounded and length > TOLD_LENGTHS)

    def accepted(self, value: bytes) -> float | None:
        """The likelihood of a value that is within all bounds."""
        if not self.possible(len(value)):
            return None
        likely = self.likelihood(value)
        return likely if self.low <= likely <= self.high and self._over_words(value, likely) > self.least_ratio else None

    def accepts(self, value: bytes) -> bool:
        return self.accepted(value) is not None


def base_matches(text: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, value) by start, then kind as listed; byte offsets."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH["assign"]]
    if any(len(w) >= MIN_LENGTH["access"] for w in text.translate(_TO_CANDIDATES).split()):
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_LENGTH["access"]]
        found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_LENGTH["hex"]]
    return sorted(found, key=lambda m: (m[0], KINDS.index(m[2])))


def _candidates(text: bytes, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """Runs of the training alphabet that no base span touches; ``taken`` is sorted by start."""
    reach, at = -1, 0  # the furthest end of the spans that start before a run ends
    for m in _CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][1]), at + 1
        if reach <= m.start():
            yield m.start(), m.end(), m[0]


def _points(text: bytes, spans: list[tuple[int, int, str, float]]) -> list[tuple[str, int, int, float]]:
    """Spans in code points."""
    if text.isascii():
        return [(kind, start, end, score) for start, end, kind, score in spans]
    heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # the bytes that begin a code point
    points = np.append(0, np.cumsum(heads))
    return [(kind, int(points[start]), int(points[end]), score) for start, end, kind, score in spans]


def _scan(texts: list[bytes | None], automata: dict[str, FormatAutomaton]) -> list[tuple[list, list]]:
    out = []
    held = list(automata.items())
    least = min((min(a.lengths, default=TOLD_LENGTHS) for _, a in held), default=0)

    @lru_cache(maxsize=1 << 16)
    def fit(value: bytes) -> tuple[float, str] | None:
        return max(((likely, kind) for kind, a in held if (likely := a.accepted(value)) is not None), default=None)

    for text in texts:
        text = text or b""
        base = base_matches(text)
        added = []
        if held and any(len(w) >= least for w in text.translate(_TO_CANDIDATES).split()):
            for start, end, value in _candidates(text, [(s, e) for s, e, _, _ in base]):
                if any(a.possible(end - start) for _, a in held) and (best := fit(value)):
                    added.append((start, end, f"format_{best[1]}", best[0]))
        spans = sorted([(s, e, k, 0.0) for s, e, k, _ in base] + added, key=lambda m: (m[0], KINDS.index(m[2]) if m[2] in KINDS else len(KINDS), m[2]))
        out.append((_points(text, [(s, e, k, 0.0) for s, e, k, _ in base]), _points(text, spans)))
    return out


SPAN = "struct<kind:string,start:bigint,end:bigint,likelihood:double>"


def _words(text: bytes, taken: list[tuple[int, int]]) -> list[bytes]:
    return [w for _, _, w in _candidates(text, taken)] if taken else _CANDIDATE.findall(text)


def _each_batch(frame: DataFrame, ddl: str, rows) -> DataFrame:
    """What ``rows`` makes of each Arrow batch of ``frame``, as columns."""
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = [{"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in ddl.split(", ")]

    def run(batches):
        for batch in batches:
            made = rows(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            while found := list(islice(made, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

    return frame.mapInArrow(run, ddl)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["text"].cast("string").cast("binary").alias("text"))


def labelled_values(docs: DataFrame) -> DataFrame:
    """(kind, value, n) of the distinct base matches of all texts; kind pair counts the pairs of characters of all words."""

    def rows(texts):
        counts, pairs = Counter(), np.zeros(49, np.int64)
        for block in blocks(texts):
            words = []
            for text in block:
                found = base_matches(text or b"")
                counts.update((k, v.decode()) for _, _, k, v in found)
                words += _words(text or b"", [(s, e) for s, e, _, _ in found])
            pairs += pair_counts(words)
        yield from ((k, v, n) for (k, v), n in counts.items())
        yield from (("pair", str(k), int(n)) for k, n in enumerate(pairs) if n)

    return _each_batch(_texts(docs), "kind string, value string, n bigint", rows).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def prefix_trees(space: Workspace, values: DataFrame, counts: dict[str, int]) -> dict[str, Tree]:
    """The prefix trees of values (kind, value) by kind; ``counts`` says how many there are of each."""

    def rows(kinds, texts):
        for kind, run in groupby(sorted(zip(kinds, texts, strict=True)), key=lambda r: r[0]):
            for block in blocks([value.encode() for _, value in run], TREE_BYTES):
                yield from ((kind, node, depth, c, child, n) for (node, depth, c, child), n in prefix_counts(block).items())

    steps = _each_batch(values.select("kind", "value"), "kind string, node binary, depth bigint, c bigint, child binary, n bigint", rows)
    counted = steps.groupBy("kind", "node", "depth", "c", "child").agg(F.sum("n").alias("n"))
    # a node has a row for each character at most
    nodes = space.save(counted.groupBy("kind", "node", "depth").agg(F.sum("n").alias("passed"), F.collect_list(F.struct("c", "n", "child")).alias("left")), "nodes")
    total = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in counts.items()])
    told = (F.col("depth") < TOLD_LENGTHS) & (F.col("passed") * TOLD >= total)
    trees = {kind: Tree() for kind in counts}
    for r in nodes.where(told).collect():
        trees[r.kind].nodes[bytes(r.node)] = (r.depth, [(x.c, x.n, None if x.child is None else bytes(x.child)) for x in r.left])
    rare = nodes.where(~told).select("kind", "depth", F.inline("left")).groupBy("kind", "depth", "c").agg(F.sum("n").alias("n"))
    for r in rare.collect():
        trees[r.kind].pooled.setdefault(r.depth, []).append((r.c, r.n))
    space.drop("nodes")
    return trees


def _word_ratios(docs: DataFrame, automata: dict[str, FormatAutomaton]) -> DataFrame:
    """(kind, bits, inside, n) of all words that are likelier in a format than among words.

    bits: the ratio, as an integer of the same order; inside: whether the likelihood is within the bounds.
    """

    def rows(texts):
        @lru_cache(maxsize=1 << 16)
        def scored(word: bytes) -> list[tuple[str, int, bool]]:
            made = [(kind, a, a.likelihood(word)) for kind, a in automata.items() if a.possible(len(word))]
            return [(kind, _bits(ratio), a.low <= likely <= a.high) for kind, a, likely in made if (ratio := a._over_words(word, likely)) > 0]

        least, counts = min(min(a.lengths, default=TOLD_LENGTHS) for a in automata.values()), Counter()
        for block in blocks(texts):
            words = Counter()
            for text in block:
                text = text or b""
                if any(len(w) >= least for w in text.translate(_TO_CANDIDATES).split()):
                    words.update(_words(text, [(s, e) for s, e, _, _ in base_matches(text)]))
            for word, n in words.items():
                for key in scored(word):
                    counts[key] += n
        yield from ((*key, n) for key, n in counts.items())

    return _each_batch(_texts(docs), "kind string, bits bigint, inside boolean, n bigint", rows).groupBy("kind", "bits", "inside").agg(F.sum("n").alias("n"))


def _left(n_words: int, below: float = WORDS_BELOW) -> float:
    """Occurrences of words that may be above the bound: one at least, as fewer words than make one can't tell such a share."""
    return max(1.0, (1 - below) * n_words)


def _bits(ratio: float) -> int:
    """A positive double as an integer; integers are in the order of the doubles."""
    return struct.unpack(">q", struct.pack(">d", ratio))[0]


def least_ratios(ratios: DataFrame, left: float) -> dict[str, float]:
    """By kind the largest ratio that words have of which, with all larger ones, there are over ``left``.

    The bits are found 16 at a time from counts by prefix, so only those are collected.
    """
    found, above = {}, {}
    for shift in (48, 32, 16, 0):
        of_prefix = F.lit(shift == 48)
        for kind, prefix in found.items():
            of_prefix |= (F.col("kind") == kind) & (F.shiftright("bits", shift + 16) == prefix)
        counted = ratios.where(of_prefix).groupBy("kind", F.shiftright("bits", shift).alias("prefix")).agg(F.sum("n").alias("n")).collect()
        found = {}
        for r in sorted(counted, key=lambda r: -r.prefix):
            if r.kind not in found:
                if above.get(r.kind, 0) + r.n > left:
                    found[r.kind] = r.prefix
                else:
                    above[r.kind] = above.get(r.kind, 0) + r.n
        if not found:
            break
    return {kind: struct.unpack(">d", struct.pack(">q", bits))[0] for kind, bits in found.items()}


def infer_formats(docs: DataFrame) -> dict[str, FormatAutomaton]:
    """An automaton for each label that has values, from all values and words of the documents."""
    space = Workspace(docs.sparkSession)
    labelled = space.save(labelled_values(docs), "labelled")
    pairs = np.zeros(49, np.int64)
    for r in labelled.where("kind = 'pair'").collect():
        pairs[int(r.value)] = r.n
    background = Background(pairs)
    values = labelled.where("kind <> 'pair'").select("kind", "value")
    found = {}
    if counts := {r.kind: r.n for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}:
        found = {k: FormatAutomaton.of_tree(t) for k, t in prefix_trees(space, values, counts).items()}

        def rows(kinds, texts):
            for kind, value in zip(kinds, map(str.encode, texts), strict=True):
                whole = found[kind].likelihood(value)
                likely = found[kind].without(value) if counts[kind] > 1 else whole
                yield kind, whole, likely, likely - background.total(value) / (len(value) + 1)

        scored = space.save(_each_batch(values, "kind string, whole double, likely double, ratio double", rows), "scored")
        likely = F.when(F.col("likely") > F.lit(-math.inf), F.col("likely"))
        for r in scored.groupBy("kind").agg(F.min(likely).alias("low"), F.max(likely).alias("high"), F.max("whole").alias("whole")).collect():
            found[r.kind].background = background
            found[r.kind]._bound([] if r.low is None else [r.low, r.high], r.whole)
        ratios = space.save(_word_ratios(docs, found), "ratios")
        bounds = least_ratios(ratios, _left(background.n_words))
        for kind, automaton in found.items():
            automaton.least_ratio = math.nextafter(bounds[kind], math.inf) if kind in bounds else 0.0
        by_kind = lambda what: F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(what(a)))) for k, a in found.items()])
        over = F.col("bits") > F.coalesce(*[F.when(F.col("kind") == k, F.lit(_bits(a.least_ratio))) for k, a in found.items()])
        above = {r.kind: r.n for r in ratios.where(F.col("inside") & over).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        accepted = F.col("likely").between(by_kind(lambda a: a.low), by_kind(lambda a: a.high)) & (F.col("ratio") > by_kind(lambda a: a.least_ratio))
        passed = {r.kind: r.n for r in scored.where(accepted).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        for kind, automaton in found.items():
            automaton.added_words = above.get(kind, 0) / max(1, background.n_words)
            automaton.recall = passed.get(kind, 0) / counts[kind]
    space.drop("labelled", "scored", "ratios")
    return {kind: found[kind] for kind in KINDS if kind in found}


def secret_spans(docs: DataFrame, name: str, automata: dict[str, FormatAutomaton], keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: base spans and all spans, in code points."""
    return with_struct(docs, name, f"base array<{SPAN}>, spans array<{SPAN}>", lambda texts: _scan(texts, automata), keep=keep)


def redact(docs: DataFrame, automata: dict[str, FormatAutomaton] | None = None) -> DataFrame:
    """The documents with every secret span of the text replaced, and n_chars, if there, to match.

    Overlapping spans are replaced together. Null texts stay null.
    """
    automata = infer_formats(docs) if automata is None else automata
    name = fresh_name(docs, "masked")

    def compute(texts):
        for text, (_, spans) in zip(texts, _scan(texts, automata), strict=True):
            if text is None or not spans:
                yield (None, False)
                continue
            chars, parts, reach = text.decode(), [], 0
            for _, start, end, _ in spans:
                if start >= reach:
                    parts += [chars[reach:start], PLACEHOLDER]
                reach = max(reach, end)
            yield ("".join([*parts, chars[reach:]]), True)

    masked = with_struct(docs, name, "text string, changed boolean", compute)
    text = F.when(masked[name]["changed"], masked[name]["text"]).otherwise(masked["text"])
    columns = {"text": text} | ({"n_chars": F.when(masked[name]["changed"], F.length(masked[name]["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(masked["n_chars"])} if "n_chars" in docs.columns else {})
    return masked.select(*[columns[c].alias(c) if c in columns else masked[c] for c in docs.columns])
