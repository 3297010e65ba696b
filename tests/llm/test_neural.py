"""The language model's counts against a plain reading of the rule, and that its probabilities sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from notewell.llm import catalog, neural

DATA = "/root/testdata/sf0.001"


def plain_tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), ""]


def test_counts_and_base_scores(spark):
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    away = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}
    counts = Counter(t for d in docs if not away[d["doc_id"]] for t in plain_tokens(d["text"]))
    total, kinds = sum(counts.values()), len(counts)
    rows = catalog.QUERIES["op11_log_bilinear"](spark, DATA).collect()
    assert len(rows) == len(docs)
    texts = {d["doc_id"]: plain_tokens(d["text"]) for d in docs}
    for r in rows:
        tokens = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (away[r.doc_id], len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens), rel=1e-12)
        assert r.score < 0


def test_rarer_words_score_alike_however_few_counts_go_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("doc_id", "text").coalesce(1)
    many, model = neural.language_scores(docs, "m", vocabulary=64)
    few, same = neural.language_scores(docs, "m", vocabulary=64, frequent=400)
    assert np.allclose(model.parameters.flat(), same.parameters.flat())
    one, two = ({r.doc_id: r.m for r in found.collect()} for found in (many, few))
    assert len(one) == 60 and all(one[k] == pytest.approx(tuple(two[k]), rel=1e-9) for k in one)


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made, model = neural.language_scores(docs, "m")
    size = len(model.parameters.b)
    assert size == neural.VOCABULARY
    for one, two in ((neural.START, neural.START), (neural.START, 5), (7, neural.UNKNOWN), (9, 40)):
        log = model.log_probabilities(np.full(size, one), np.full(size, two), np.arange(size))
        assert np.delete(np.exp(log), neural.START).sum() == pytest.approx(1, abs=1e-4)
    lex = model.lexicon
    outside = [int(c) for c, s, w in zip(lex.counts, lex.symbols, lex.words, strict=True) if not s and c and w]
    assert sum(outside) == lex.unknown_tokens and len(outside) == lex.unknown_distinct
    judged = made.where(neural.held_out(F.col("doc_id"))).agg(F.sum("m.score").alias("score"), F.sum("m.base_score").alias("base"), F.sum("m.n_tokens").alias("n")).first()
    assert judged.score > judged.base + 0.02 * judged.n


def test_training_learns_which_symbol_follows():
    symbols = np.tile(np.array([3, 4, 5, 6]), 4000)
    noise = np.array([0.05, 0.05, 0.0, 0.225, 0.225, 0.225, 0.225])
    trainer = neural.Trainer(neural.Parameters.fresh(noise, 8), noise, seed=1)
    one, two = neural.sequences(symbols, np.array([0]))
    for _ in range(12):
        for k in range(0, len(symbols), 500):
            trainer.step(one[k : k + 500], two[k : k + 500], symbols[k : k + 500])
    p = trainer.p
    table = np.stack([p.log_normalisers(np.full(7, a), np.arange(7)) for a in range(7)])
    model = neural.Model(None, p, table)
    assert np.exp(model.log_probabilities(np.array([3, 4, 5]), np.array([4, 5, 6]), np.array([5, 6, 3]))).min() > 0.8


def test_contexts_stop_at_the_start_of_a_text():
    symbols, starts = np.array([7, 8, 1, 1, 9, 1], np.int32), np.array([0, 3, 4])
    one, two = neural.sequences(symbols, starts)
    assert two.tolist() == [2, 7, 8, 2, 2, 9] and one.tolist() == [2, 2, 7, 2, 2, 2]


def test_awkward_rows(spark, awkward, nothing):
    made, model = neural.language_scores(awkward, "N_WORDS")
    assert made.columns == [*awkward.columns[:-1], "N_WORDS"]
    rows = made.collect()
    assert len(rows) == awkward.count() and all(r.N_WORDS.n_tokens >= 1 and r.N_WORDS.score < 0 for r in rows)
    assert all(r.N_WORDS.n_tokens == 1 for r in rows if not (r.text or "").strip())
    empty, model = neural.language_scores(nothing, "m")
    assert empty.count() == 0 and model.lexicon.tokens == 0
    held = awkward.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("bigint"))
    untrained = neural.scored(held, neural.word_counts(nothing.select("text", F.lit(False).alias("held"))), model, "m").collect()
    assert [(r.m.n_known, r.m.base_score) for r in untrained] == [(0, 0.0)] and untrained[0].m.score < 0
