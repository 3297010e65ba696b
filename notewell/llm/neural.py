"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation.

Every word of the training texts is counted (shuffled once, combined in tasks). The ``vocabulary``
most frequent words, an unknown word, the end and the start are the model's symbols. A symbol's score
after two others is bilinear, ``(c1 * r[u] + c2 * r[v]) . t[w] + b[w]``; the parameters start as the
unigram model and learn to tell each training token from shared noise draws, so training never sums
over the vocabulary. All training texts take part: each task goes over its own texts by AdaGrad from
common parameters, which are then averaged by tokens, in a tree of tasks; a first round over one
document in ``WARM_UP`` sets the common start.

Probabilities are normalised exactly. As the normaliser depends on the two symbols before alone, matrix
products give it once for all ``vocabulary`` squared pairs, and scoring looks it up. Words outside
the vocabulary get the unknown word's probability times their add-one share of its tokens, so the
probabilities of all words sum to one (one unseen word counted).

Scoring is one scan. Counts of the ``frequent`` most frequent words go out to tasks (a bounded
table); the rarer words of each text join the count table by word, and none of these is frequent, so
no key is hot. What is collected or sent out is bounded by ``vocabulary`` and ``frequent``; the
counts grow with the corpus and stay on the executors.

Defined results: a null text counts as empty, which is one end token; a null doc_id trains; repeated
rows train and are scored one by one; without training texts every count is 0 and the model
is uniform; an empty table gives an empty result. Parameters depend on how rows are dealt over tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace, blocks, fresh_name, with_struct

VOCABULARY = 1_024
FREQUENT = 200_000
DIMENSIONS = 24
BATCH = 2_048
NOISE = 32
RATE = 0.08
WARM_UP = 8
FOLDS, HELD_FOLD = 7, 2
HELD_WORDS = 150_000
#: Rows of a batch that are turned into Python objects together.
ROWS = 512
CHUNK = 65_536
#: Steps of a doubling by which counts are told apart.
COUNT_STEPS = 16
#: Rows of parameters that come to the driver at most.
PARAMETER_ROWS = 64

UNKNOWN, END, START = 0, 1, 2
FIRST_WORD = 3


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder HELD_FOLD of FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def text_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


# ------------------------------------------------------------------ counts
def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n_train, n_held) of all words of (text, held); the end token is the empty word."""

    def batch_of(train: Counter, held: Counter) -> pa.RecordBatch:
        words = list(train.keys() | held.keys())
        numbers = [pa.array([c[w] for w in words], pa.int64()) for c in (train, held)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), *numbers], names=["word", "n_train", "n_held"])

    def run(batches):
        train, held = Counter(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for text, away in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = held if away else train
                    counts.update(text_words(text))
                    counts[b""] += 1
                    if len(train) + len(held) >= HELD_WORDS:
                        yield batch_of(train, held)
                        train, held = Counter(), Counter()
        yield batch_of(train, held)

    made = texts.select(texts["text"].cast("string").cast("binary"), "held").mapInArrow(run, "word string, n_train bigint, n_held bigint")
    return made.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_held").alias("n_held"))


def _least_count(counts: DataFrame, wanted: int) -> int:
    """A count that at least ``wanted`` words reach (or 0), and few more: so that not every task sorts ``wanted`` words."""
    share = F.floor(F.log2("n") * COUNT_STEPS)
    left = wanted
    for r in sorted(counts.groupBy(share.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        left -= r.words
        if left <= 0:
            return r.least
    return 0


@dataclass
class Lexicon:
    """Counts of the most frequent words, and of all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    symbols: np.ndarray
    n_symbols: int
    tokens: int
    distinct: int
    unknown_tokens: int
    unknown_distinct: int
    noise: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, counts: DataFrame, vocabulary: int, frequent: int) -> Lexicon:
        total = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
        every = counts.select("word", "n_train", (F.col("n_train") + F.col("n_held")).alias("n"))
        most = every.where(F.col("n") >= _least_count(every, frequent)).orderBy(F.desc("n"), "word").limit(frequent).toArrow()
        words = [w.encode() for w in most.column("word").to_pylist()]
        n_train = most.column("n_train").to_numpy().astype(np.int64)
        symbols = np.full(len(words), UNKNOWN, np.int32)
        chosen = [k for k in np.argsort(-n_train, kind="stable").tolist() if words[k] and n_train[k] > 0][: max(0, vocabulary - FIRST_WORD)]
        symbols[chosen] = np.arange(FIRST_WORD, FIRST_WORD + len(chosen))
        n_symbols = FIRST_WORD + len(chosen)
        ends = int(sum(n for w, n in zip(words, n_train.tolist(), strict=True) if not w))
        inside = int(n_train[chosen].sum()) + ends
        weights = np.zeros(n_symbols)
        weights[FIRST_WORD:] = n_train[chosen] + 1
        weights[UNKNOWN], weights[END] = total.n - inside + 1, ends + 1
        return cls(words, n_train, symbols, n_symbols, total.n, total.v, total.n - inside, total.v - len(chosen) - (ends > 0), weights / weights.sum())

    def lookup(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}

    def symbol_of(self) -> dict[bytes, int]:
        return {self.words[k]: int(s) for k, s in enumerate(self.symbols) if s}


# ------------------------------------------------------------------ model
@dataclass
class Parameters:
    r: np.ndarray
    t: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @classmethod
    def fresh(cls, noise: np.ndarray, dimensions: int, seed: int = 11) -> Parameters:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        with np.errstate(divide="ignore"):
            b = np.where(noise > 0, np.log(np.maximum(noise, 1e-300)), 0.0).astype(np.float32)
        return cls(draw(len(noise), dimensions), draw(len(noise), dimensions), np.ones((2, dimensions), np.float32), b)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.r, self.t, self.c, self.b)])

    def like(self, flat: np.ndarray) -> Parameters:
        made, at = [], 0
        for a in (self.r, self.t, self.c, self.b):
            made.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Parameters(*made)

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[one] + self.c[1] * self.r[two]

    def log_normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the sum over all symbols but the start, for pairs of symbols before."""
        scores = self.context(one, two) @ self.t.T + self.b
        scores[:, START] = -np.inf
        top = scores.max(axis=1)
        return top + np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype=np.float64))


def _summed(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by id."""
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[ordered[heads]] = np.add.reduceat(rows[order], heads, axis=0)
    return out


class Trainer:
    """AdaGrad on the noise-contrastive loss, in batches of tokens with shared noise."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int, rate: float = RATE, draws: int = NOISE) -> None:
        self.p = Parameters(*(a.copy() for a in (start.r, start.t, start.c, start.b)))
        self.rate, self.draws, self.rng = rate, draws, np.random.default_rng(seed)
        self.reach = np.cumsum(noise)
        with np.errstate(divide="ignore"):
            self.shift = np.log(draws * noise).astype(np.float32)
        self.squares = [np.full(a.shape, 1e-2, np.float32) for a in (self.p.r, self.p.t, self.p.c, self.p.b)]

    def _move(self, which: int, parameter: np.ndarray, gradient: np.ndarray) -> None:
        self.squares[which] += gradient * gradient
        parameter += self.rate * gradient / np.sqrt(self.squares[which])

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        p, size = self.p, len(self.p.b)
        drawn = np.minimum(np.searchsorted(self.reach, self.rng.random(self.draws), "right"), size - 1)
        r1, r2, t = p.r[one], p.r[two], p.t[target]
        q = p.c[0] * r1 + p.c[1] * r2
        true = np.einsum("ij,ij->i", q, t) + p.b[target] - self.shift[target]
        false = q @ p.t[drawn].T + p.b[drawn] - self.shift[drawn]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        dq = up[:, None] * t + down @ p.t[drawn]
        dt = _summed(np.concatenate([target, drawn]), np.concatenate([up[:, None] * q, down.T @ q]), size)
        db = np.bincount(target, up, size) + np.bincount(drawn, down.sum(axis=0), size)
        dr = _summed(np.concatenate([one, two]), np.concatenate([dq * p.c[0], dq * p.c[1]]), size)
        dc = np.stack([(dq * r1).sum(axis=0), (dq * r2).sum(axis=0)])
        for which, (parameter, gradient) in enumerate(((p.r, dr), (p.t, dt), (p.c, dc / len(target)), (p.b, db.astype(np.float32)))):
            self._move(which, parameter, gradient)


def sequences(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two before and one before each, the start where a text has none."""
    one, two = np.full(len(symbols), START, symbols.dtype), np.full(len(symbols), START, symbols.dtype)
    two[1:], one[2:] = symbols[:-1], symbols[:-2]
    two[starts] = one[starts] = START
    second = starts + 1
    one[second[second < len(symbols)]] = START
    return one, two


def _flat(texts: list[bytes | None], place, end: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Numbers of all words of the texts, each text with ``end`` after it; the first place of each text; the words."""
    words = [text_words(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in words])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    numbers = np.full(int(sizes.sum()), end, np.int32)
    inside = np.ones(len(numbers), bool)
    inside[starts + sizes - 1] = False
    numbers[inside] = np.fromiter((place(w) for ws in words for w in ws), np.int32, int(inside.sum()))
    return numbers, starts, words


def _trained(texts: DataFrame, lexicon, start: Parameters) -> DataFrame:
    """A row for each task that has text: its tokens and their parameters times the tokens."""

    def run(batches):
        known = lexicon.value
        symbol_of = known.symbol_of()
        place = lambda w: symbol_of.get(w, UNKNOWN)
        trainer, seen = Trainer(start, known.noise, seed=5), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for block in blocks(batch.column(0).slice(at, ROWS).to_pylist()):
                    symbols, starts, _ = _flat(block, place, END)
                    one, two = sequences(symbols, starts)
                    for k in range(0, len(symbols), BATCH):
                        trainer.step(one[k : k + BATCH], two[k : k + BATCH], symbols[k : k + BATCH])
                    seen += len(symbols)
        if seen:
            flat = trainer.p.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])

    return texts.mapInArrow(run, "n bigint, flat binary")


def _added(batches):
    n, flat = 0, None
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, flat = n + k, np.frombuffer(v) if flat is None else flat + np.frombuffer(v)
    if flat is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])


@dataclass
class Model:
    lexicon: Lexicon
    parameters: Parameters
    #: by the symbol two before, then the one before
    normalisers: np.ndarray

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol after two others."""
        p = self.parameters
        out = np.empty(len(target))
        for k in range(0, len(target), CHUNK):
            a, b, w = one[k : k + CHUNK], two[k : k + CHUNK], target[k : k + CHUNK]
            out[k : k + CHUNK] = np.einsum("ij,ij->i", p.context(a, b), p.t[w]) + p.b[w] - self.normalisers[a, b]
        return out


def _averaged(texts: DataFrame, lexicon, start: Parameters, space: Workspace, name: str) -> Parameters:
    rows = space.save(_trained(texts, lexicon, start), name)
    parts = texts.rdd.getNumPartitions()
    while parts > PARAMETER_ROWS:
        parts = max(PARAMETER_ROWS, isqrt(parts))
        rows = rows.repartition(parts).mapInArrow(_added, "n bigint, flat binary")
    found = rows.collect()
    space.drop(name)
    n = sum(r.n for r in found)
    return start.like(sum(np.frombuffer(r.flat) for r in found) / n) if n else start


def _normalisers(spark, parameters: Parameters) -> np.ndarray:
    size = len(parameters.b)

    def run(batches):
        for batch in batches:
            for one in batch.column(0).to_pylist():
                row = parameters.log_normalisers(np.full(size, one), np.arange(size)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([row.tobytes()], pa.binary())], names=["one", "row"])

    found = spark.range(0, size, 1, 32).mapInArrow(run, "one bigint, row binary").collect()
    return np.stack([np.frombuffer(r.row, np.float32) for r in sorted(found)])


def fit(docs: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT, dimensions: int = DIMENSIONS) -> Model:
    """A model of the rows of (text, held) outside the held-out fold, whose words are in ``counts``."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    lexicon = Lexicon.of(counts, vocabulary, frequent)
    shared = spark.sparkContext.broadcast(Lexicon([w for k, w in enumerate(lexicon.words) if lexicon.symbols[k]], lexicon.counts[:0], lexicon.symbols[lexicon.symbols > 0], lexicon.n_symbols, 0, 0, 0, 0, lexicon.noise))
    train = docs.where(~F.col("held")).select(F.col("text").cast("string").cast("binary").alias("text"))
    parameters = Parameters.fresh(lexicon.noise, dimensions)
    parameters = _averaged(train.where(F.xxhash64("text") % WARM_UP == 0), shared, parameters, space, "warm")
    parameters = _averaged(train, shared, parameters, space, "trained")
    return Model(lexicon, parameters, _normalisers(spark, parameters))


# ------------------------------------------------------------------ scores
class _Scorer:
    """What a scan can tell of each text: all but the counts of its rarer words."""

    def __init__(self, model) -> None:
        self.model, self.lookup = model, None

    def __call__(self, texts: list[bytes | None]):
        m: Model = self.model.value
        lex = m.lexicon
        if self.lookup is None:
            found = lex.lookup()
            self.lookup = found.get
            self.end = found.get(b"", len(lex.words) + 1)
            # one place for a rarer word, one for an end that no text was trained on
            self.log_count = np.log10(np.append(lex.counts, [0, 0]) + 1.0)
            self.is_known = np.append(lex.counts > 0, [False, False]).astype(np.int64)
            self.symbol = np.append(lex.symbols, [UNKNOWN, END]).astype(np.int32)
            self.symbol[self.end] = END
        rare, lookup = len(lex.words), self.lookup
        places, starts, words = _flat(texts, lambda w: lookup(w, rare), self.end)
        symbols = self.symbol[places]
        one, two = sequences(symbols, starts)
        logs = self.log_count[places]
        unknown = symbols == UNKNOWN
        share = math.log10(lex.unknown_tokens + lex.unknown_distinct + 1)
        model = m.log_probabilities(one, two, symbols) / math.log(10) + unknown * (logs - share)
        sums = [np.add.reduceat(x, starts).tolist() for x in (self.is_known[places], logs, model)]
        rarely = np.flatnonzero(places == rare)
        cuts = np.searchsorted(rarely, np.append(starts, len(places))).tolist()
        for k, (start, n_known, base, score) in enumerate(zip(starts.tolist(), *sums, strict=True)):
            n = len(words[k]) + 1
            few = Counter(words[k][i - start] for i in rarely[cuts[k] : cuts[k + 1]].tolist())
            yield n, n_known, base - n * math.log10(lex.tokens + lex.distinct + 1), score, [w.decode() for w in few], list(few.values())


def scored(docs: DataFrame, counts: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: n_tokens, n_known, base_score and score of each text."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    row = fresh_name(docs, "row")
    shared = spark.sparkContext.broadcast(model)
    ddl = "n_tokens bigint, n_known bigint, base_score double, score double, words array<string>, times array<bigint>"
    part = space.save(with_struct(docs.withColumn(row, F.monotonically_increasing_id()), name, ddl, _Scorer(shared)), "scanned")
    rare = part.select(F.col(row).alias("__at"), F.explode(F.arrays_zip(f"{name}.words", f"{name}.times")).alias("w")).select("__at", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts.where("n_train > 0").select("word", "n_train"), "word")
    more = met.groupBy("__at").agg(F.sum("times").alias("__known"), F.sum(F.col("times") * F.log10(F.col("n_train") + 1.0)).alias("__log"))
    log, known = F.coalesce("__log", F.lit(0.0)), F.coalesce("__known", F.lit(0))
    made = F.struct(part[name]["n_tokens"].alias("n_tokens"), (part[name]["n_known"] + known).alias("n_known"), (part[name]["base_score"] + log).alias("base_score"), (part[name]["score"] + log).alias("score"))
    return part.join(more, part[row] == F.col("__at"), "left").select(*[part[c] for c in docs.columns if c.lower() != name.lower()], made.alias(name))


def language_scores(docs: DataFrame, name: str, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> tuple[DataFrame, Model]:
    """``scored`` by a model of the documents outside the held-out fold of ``doc_id``, and that model."""
    space = Workspace(docs.sparkSession)
    fed = docs.select(docs["text"], held_out(docs["doc_id"]).alias("held"))
    counts = space.save(word_counts(fed), "words")
    model = fit(fed, counts, vocabulary, frequent)
    return scored(docs, counts, model, name), model
