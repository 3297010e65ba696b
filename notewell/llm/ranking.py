"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

A document labelled 1 is preferred to one labelled 0. The weights minimise the logistic loss of
feature differences over such pairs (ridge-penalised Newton steps), so a document's score is a
linear function of its features; the cut between the labels is the score quantile at the share
of label 0. Scores are mapped to 0..1 so that this cut lands on ``at``.

Training sees a bounded sample: at most ``max_labelled`` labelled rows (the smallest by hash) and
``max_pairs`` pairs of them. Features come from the whole text alone; every document is scored,
in one scan without a shuffle.

Defined results: null and empty texts have all features 0 and get a score like any other; label
rows with a null doc_id or label are ignored, and the larger of several labels of a document
counts; without both labels every score is 0.5; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import space_words, with_struct

MAX_LABELLED = 20_000
MAX_PAIRS = 200_000
RIDGE = 1e-3
THRESHOLD = 0.3
FOLDS = 5

FEATURES = (
    "log_words", "word_length", "distinct_share", "top_word_share", "adjacent_repeats", "symbol_share", "upper_share", "exclamation_share",
    "bar_share", "digit_share", "repeated_lines", "stop_share", "lower_starts", "line_length",
)

_DROP = {name: bytes(set(range(256)) - set(kept)) for name, kept in {"symbol": b"#*$%&<>", "upper": bytes(range(65, 91)), "digit": b"0123456789"}.items()}


def _share(part: float, whole: float) -> float:
    """A share on a log scale, which tells 1 % from 3 % as well as 20 % from 60 %."""
    return math.log1p(100 * part / whole) if whole else 0.0


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = space_words(text)
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line]
    kept = {k: len(text.translate(None, drop)) for k, drop in _DROP.items()}
    return [
        math.log1p(n),
        math.log1p(size / n),
        len(counts) / n,
        _share(max(counts.values()) - 1, n),
        _share(sum(map(bytes.__eq__, words, words[1:])), n),
        _share(kept["symbol"], size),
        _share(kept["upper"], size),
        _share(text.count(b"!"), size),
        _share(counts.get(b"|", 0), n),
        _share(kept["digit"], size),
        _share(len(lines) - len(set(lines)), len(lines) or 1),
        _share(sum(w.endswith((b".", b",")) for w in words), n),
        _share(sum(w[:1].islower() for w in words), n),
        math.log1p(size / (len(lines) or 1)),
    ]


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float = THRESHOLD

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, max_pairs: int = MAX_PAIRS, at: float = THRESHOLD, seed: int = 7) -> Ranking:
        rows = np.asarray(rows, float).reshape(-1, len(FEATURES))
        width = rows.shape[1]
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        if not len(good) or not len(bad):
            return cls(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
        mean, scale = rows.mean(axis=0), rows.std(axis=0)
        scale[scale < 1e-9] = 1.0
        unit = (rows - mean) / scale
        rng = np.random.default_rng(seed)
        pairs = unit[rng.choice(good, max_pairs)] - unit[rng.choice(bad, max_pairs)]
        weights = np.zeros(width)
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(pairs @ weights, -30, 30)))
            gradient = -(pairs.T @ p) / len(pairs) + RIDGE * weights
            curvature = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + RIDGE * np.eye(width)
            step = np.linalg.solve(curvature, gradient)
            weights = weights - step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, weights, float(np.quantile(unit @ weights, len(bad) / len(labels))), at)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        raw = ((rows - self.mean) / self.scale) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + math.log(self.at / (1 - self.at)), -500, 500)))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder 0 of FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def labelled_features(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded training sample, outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("labelled"), "labelled").limit(max_labelled)
    # at most max_labelled rows of two numbers go out
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("labelled", "text", "quality")
    found = with_struct(joined, "made", "x array<double>", lambda texts: ((features(t),) for t in texts), keep=["labelled", "quality"])
    # of rows that repeat an id the smallest features count, so that the fit doesn't depend on the order of rows
    rows = found.groupBy("labelled", "quality").agg(F.min("made.x").alias("x")).collect()
    rows.sort(key=lambda r: (r.labelled, r.x))
    return np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([int(r.quality) for r in rows])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pairs: int = MAX_PAIRS) -> Ranking:
    return Ranking.fit(*labelled_features(docs, labels, max_labelled), max_pairs)


def quality_scores(docs: DataFrame, name: str, ranking: Ranking, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: the score of each whole text and whether it passes."""

    def compute(texts):
        for score in ranking.scores(np.array([features(t) for t in texts])).tolist():
            yield score, int(score >= THRESHOLD)

    return with_struct(docs, name, "score double, predicted int", compute, keep=keep)
