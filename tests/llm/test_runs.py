"""Periodic runs against a plain reading of the rule."""

import random

import numpy as np
from pyspark.sql import functions as F

from notewell.llm import runs


def plain_runs(ids, min_words):
    found, seen = [], set()
    for p in range(1, len(ids) // 3 + 1):
        i = 0
        while i + p < len(ids):
            begin = i
            while i + p < len(ids) and ids[i] == ids[i + p]:
                i += 1
            length = i - begin + p
            if i > begin and length >= max(min_words, 3 * p) and (begin, length) not in seen:
                seen.add((begin, length))
                found.append((begin, length, p))
            i += i == begin
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        n, kinds = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 4])
        ids = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 8 else 0):
            start = rng.randrange(n)
            period, length = rng.randint(1, max(1, (n - start) // 2)), rng.randint(1, n - start)
            for i in range(start + period, start + length):
                ids[i] = ids[i - period]
        least = rng.choice([3, 6, 24])
        assert runs.periodic_runs(np.array(ids, np.int64), least) == plain_runs(ids, least)


def test_long_periodic_texts_are_one_run():
    for words, period in ((["lorem", "ipsum", "dolor"], 3), ([str(k) for k in range(10_007)], 10_007)):
        text = words * (120_000 // len(words))
        assert runs.periodic_runs(runs._numbered([w.encode() for w in text])) == [(0, len(text), period)]


def test_planted_ends():
    words = [str(k).encode() for k in range(100)]
    assert runs.planted(words, 7) == words and runs.planted([], 10) == []
    key = 10 * (8 * 25 + 20 - 20 % 8)  # g = 216: the words from 16 on repeat every 1 + 84 // 3
    made = runs.planted(words, key)
    a, p = (key // 10) % 100, 1 + (100 - (key // 10) % 100) // (3 + (key // 10) % 8)
    assert made == [words[i if i < a else a + (i - a) % p] for i in range(100)]


def test_awkward_rows(spark, awkward, nothing):
    found = runs.collapsed(awkward, "N_WORDS", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    assert found.columns == [*awkward.columns[:-1], "N_WORDS"] and found.count() == awkward.count()
    rows = [r for r in found.collect() if r.text in (None, "", " \n\t ")]
    assert len(rows) == 4 and all(tuple(r.N_WORDS) == (0, [], "") for r in rows)
    [long] = [r.m for r in runs.collapsed(awkward, "m").collect() if r.doc_id == 7]
    assert [tuple(r) for r in long.runs] == [(0, 120_000, 3)] and long.collapsed == "lorem ipsum dolor"
    assert runs.collapsed(nothing, "m").count() == 0


def test_strongest_run(spark):
    rows = [(1, [(0, 30, 10), (40, 60, 20), (50, 90, 20)]), (2, [(5, 30, 10), (7, 60, 20)]), (3, [])]
    got = spark.createDataFrame(rows, f"k int, runs array<{runs.RUN}>").select("k", runs.strongest(F.col("runs")).alias("b")).collect()
    assert {r.k: r.b and tuple(r.b) for r in got} == {1: (50, 90, 20), 2: (5, 30, 10), 3: None}
