"""The operators on awkward rows, against brute force, and on other parameters."""

import itertools
import math
import collections
import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.llm import components, debruijn, decontaminate, jaccard, licences, mixing, privacy, ranking, repetition, secrets, warc
from notewell.llm.common import Workspace, alnum_words, space_words
from notewell.llm.grams import gram_hashes, word_hashes


def test_word_definitions():
    text = "A-b\x0bÉc d\x1fE 9".encode()
    assert [w.decode() for w in space_words(text)] == ["A-b", "Éc d\x1fE", "9"]
    assert [w.decode() for w in alnum_words(text)] == ["a", "b", "Éc d", "e", "9"]
    assert space_words(None) == alnum_words(b"") == []


def test_hashes_depend_on_words_alone():
    texts = [b"a bb  a", None, b"bb a a", b" ", b"x" * 3_000_000 + b" a"]
    hashes, bounds, lengths = word_hashes(texts)
    assert np.diff(bounds).tolist() == [3, 0, 3, 0, 2]
    assert hashes[0] == hashes[2] == hashes[4] == hashes[7] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3
    assert lengths.tolist() == [1, 2, 1, 2, 1, 1, 3_000_000, 1]
    assert gram_hashes(hashes[:3], 2)[1] == gram_hashes(hashes[3:6], 2)[0] and not len(gram_hashes(hashes[:1], 2))


# ------------------------------------------------------------------ 1
def test_warc_round_trip_of_awkward_pages(spark):
    rows = [(1, "http://a", "x" * 40_000), (2, "http://b\r\nX: 1", "x" * 40_000), (3, None, None), (4, "http://c", ""), (5, "u", "é\r\n\r\nWARC/1.0\r\n\r\n0\r\n"), (6, "t", "t"), (6, "t", "t"), (None, "n", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.round_trip(pages, segment_bytes=3_000, chunk_bytes=700).collect()
    assert len(got) == 8 and {r.status for r in got} == {"ok"}
    by = {r.page_id: r for r in got if r.page_id != 6}
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[2].payload_bytes) == ("response", "revisit", 1, 40_000)
    assert by[1].segments > 10 and bytes(by[1].payload).decode() == "x" * 40_000 and by[1].payload_digest == by[2].payload_digest
    assert (by[3].record_type, by[4].record_type, by[4].refers_to, by[3].payload_digest) == ("response", "revisit", 3, "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ")
    assert bytes(by[5].payload).decode() == rows[4][2] and by[None].record_type == "response"
    assert [r.record_type for r in got if r.page_id == 6] == ["response"] * 2
    assert all(r.record_type == "response" for r in warc.round_trip(pages, revisit_bytes=50_000).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_segments_and_framing_are_told():
    parts = [{"segment": 1, "block": b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nab"}, {"segment": 2, "block": b"c\r\n0\r\n\r\n"}]
    import pyarrow as pa

    def read(parts, total):
        row = {"kind": "response", "page_id": 1, "url": "u", "block": None, "payload_bytes": 3, "payload_digest": warc.digest(b"abc"), "refers_to": None, "status": "ok", "total": total, "parts": parts}
        return next(warc._whole([pa.RecordBatch.from_pylist([row])])).to_pylist()[0]

    size = sum(len(p["block"]) for p in parts)
    assert (read(parts, size)["payload"], read(parts, size)["status"]) == (b"abc", "ok")
    assert read(parts, size + 1)["status"] == "total length differs" and read(parts[1:], size)["status"] == "segments missing" and read(parts, None)["status"] == "segments missing"
    assert warc.unchunked(b"5\r\nab") is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"0\r\n\r\n") == b""
    assert warc.unchunked(warc.chunked(b"hello world", 3)) == b"hello world"


# ------------------------------------------------------------------ 2
def repeats_model(words, least):
    n, covered, longest = len(words), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered |= {*range(i, i + k), *range(j, j + k)}
    return len(covered), longest


def test_repeats_against_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(words + (words[3:9] * 2 if rng.random() < 0.5 else [])).encode())
    for text, row in zip(texts, repetition._judge(texts, 4, 40, 100), strict=True):
        assert (row[7], row[8]) == repeats_model(text.split(), 4)


def test_rules_on_awkward_rows(awkward, nothing):
    rows = {(r.doc_id, r.text): r.rules for r in repetition.repetition_rules(awkward, "rules").collect()}
    assert rows[4, None].n_words == 0 and rows[4, None].base_failed and not rows[4, None].kept
    assert rows[6, " \n\t "].word_chars == 0 and rows[7, next(t for i, t in rows if i == 7)].longest_repeat > 100_000
    assert repetition.passing(awkward).columns == awkward.columns and repetition.passing(nothing).count() == 0


# ------------------------------------------------------------------ 3
def linked(one, other):
    return one and other and 100 * len(one & other) >= 80 * len(one | other)


def grams(text, size=5):
    words = (text or "").lower().split()
    size = min(size, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def components_model(texts):
    sets, label = {k: grams(t) for k, t in texts.items()}, {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if linked(sets[a], sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("leaf", [4, 256])
def test_join_against_brute_force(spark, leaf):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = {}
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 40, 90]))]
        for _ in range(rng.choice([1, 3, 14])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(words + (passage if family % 3 == 0 else []))
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, leaf=leaf, hot_rows=3, reported=1).collect()}
    assert got == components_model(texts)


def test_join_by_several_levels_of_cells(spark, monkeypatch):
    """All documents in one region: clusters that pivots part, each of them dense."""
    rng, levels, divided = random.Random(4), [], jaccard._divided

    def spy(measured, sized, between, space, level, *how):
        levels.append(level + 1)
        return divided(measured, sized, between, space, level, *how)

    monkeypatch.setattr(jaccard, "_divided", spy)
    monkeypatch.setattr(jaccard, "region_members", lambda sets, space, similar: sets.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id")).select(F.lit(0).cast("bigint").alias("pivot"), "doc_id"))
    texts = {}
    for cluster in range(6):
        tail = [f"{cluster}t{j}" for j in range(60)]
        for k in range(10):
            words = list(tail)
            for _ in range(1 if k == 0 else rng.randint(2, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            texts[len(texts)] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, leaf=4, hot_rows=10_000).collect()}
    assert got == components_model(texts)
    assert max(levels) >= 2


def test_dense_cells_meet_every_pair_within_the_radius(spark):
    rng = random.Random(2)
    rows = [("c", k, 0 if k < 30 else k, rng.random()) for k in range(60)]
    places = jaccard._bins(spark.createDataFrame(rows, "cell string, doc_id bigint, grp bigint, away double"), 80, 8).collect()
    tasks = {}
    for r in places:
        tasks.setdefault(r.task, []).append(r.doc_id)
    assert all(len(ids) == len(set(ids)) for ids in tasks.values())
    met = {frozenset(p) for ids in tasks.values() for p in itertools.combinations(ids, 2)}
    for (_, a, ga, da), (_, b, gb, db) in itertools.combinations(rows, 2):
        assert abs(da - db) > 0.2 or ga == gb or {a, b} in met


def test_join_on_awkward_rows(awkward, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(awkward).collect()), key=repr)
    by = {i: (n, c) for i, n, c in got if i not in (None, 10)}
    assert len(got) == awkward.count() and by[2] == by[1] and by[3][1] == 1 and by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6)
    assert by[8] == by[9] == (1, 8) and by[7] == (3, 7) and [c for i, _, c in got if i is None] == [None, None]
    assert {c for i, _, c in got if i == 10} == {10}
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 4, 5, 6, 7, 8, None, None]
    assert jaccard.near_duplicates(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(edges, Workspace(spark), "t").collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100


# ------------------------------------------------------------------ 4
def shares_model(total, children):
    """Water filling by repeated rounds: (weight, capacity) of each child to its share."""
    share, open_, left = dict.fromkeys(children, 0), set(children), total
    while open_:
        weight = sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] * weight <= left * children[c][0]}
        if not full:
            return share | {c: left * children[c][0] // weight for c in open_}
        for c in full:
            share[c] = children[c][1]
        left -= sum(children[c][1] for c in full)
        open_ -= full
    return share


def test_shares_against_water_filling(spark):
    rng = random.Random(4)
    for _ in range(6):
        children = {f"c{k}": (rng.randint(1, 5), rng.randint(0, 50)) for k in range(7)}
        total = min(rng.randint(1, 150), sum(c for _, c in children.values()))
        rows = [(n, w, c, total) for n, (w, c) in children.items()]
        nodes = spark.createDataFrame(rows, "name string, weight bigint, capacity bigint, offered bigint")
        assert {r.name: r.budget for r in mixing.shared_out(nodes, [], "name").collect()} == shares_model(total, children)


def test_mixture_on_awkward_rows(awkward, nothing):
    mix = mixing.Mix({"language": {"en": 3}}, max_epochs=2)
    got = mixing.mixture(awkward, mix).collect()
    assert all(1 <= r.epochs <= 2 for r in got) and {r.language for r in got} <= {"en", "fr", "de", "es", "unknown"}
    assert sum(r.n_tokens * r.epochs for r in got) <= sum(len((r.text or "").split()) for r in awkward.collect())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(awkward.repartition(3), mix).collect()))
    assert mixing.mixture(nothing).count() == 0


# ------------------------------------------------------------------ 5
def test_ranking_orders_and_maps_the_cut():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, len(ranking.FEATURES)))
    labels = (rows[:, 2] > -0.8).astype(int)
    model = ranking.Ranking.fit(rows, labels, 5_000)
    assert ((model.scores(rows) >= ranking.THRESHOLD) == labels).mean() > 0.97
    flat = ranking.Ranking.fit(rows, np.ones(300))
    assert set(flat.scores(rows).tolist()) == {0.5}


def test_ranking_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (8, 0), (8, 1), (None, 1), (9, None), (7, 0)], "doc_id bigint, quality int")
    model = ranking.fit(awkward, labels)
    scored = ranking.quality_scores(awkward, "n", model).collect()
    assert len(scored) == awkward.count() and all(0 <= r.n.score <= 1 for r in scored)
    assert ranking.quality_scores(nothing, "n", ranking.fit(nothing, labels.limit(0))).count() == 0


# ------------------------------------------------------------------ 6
def test_automata_score_formats_and_refuse_others():
    rng = random.Random(2)
    keys = ["ghx_" + "".join(rng.choice("0123456789ABCDEF") for _ in range(20)) for _ in range(200)]
    automaton = secrets.FormatAutomaton([k.encode() for k in keys])
    fresh = "ghx_" + "".join(rng.choice("0123456789ABCDEF") for _ in range(20))
    assert automaton.accepts(fresh.encode()) and not automaton.accepts(b"plainwordswith1digit") and not automaton.accepts(b"20240101-123456-abcdef")
    assert automaton.size == 25 and automaton.lengths == {24} and not automaton.unbounded and automaton.recall >= 0.9


def test_automata_know_lengths_and_hold_out_values():
    rng = random.Random(21)
    code = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n)).encode()
    hexes, cards = [code("0123456789abcdef", 40) for _ in range(130)], [(code("0123456789", 16), 1) for _ in range(80)]
    words = [(w, 50) for w in (b"thornted", b"everything", b"Weatherer.", b"understanding.")] + cards
    fixed = secrets.FormatAutomaton(hexes, words)
    assert fixed.lengths == {40} and fixed.size == 41 and fixed.recall >= 0.9 and fixed.added_words == 0
    assert fixed.accepts(code("0123456789abcdef", 40)) and not fixed.accepts(code("0123456789abcdef", 39)) and not fixed.accepts(cards[0][0]) and not fixed.accepts(b"z" * 40)
    # one pattern of varying length: states merge
    loose = secrets.FormatAutomaton([b"tk-" + code("abcdef0123456789", rng.randint(12, 40)) for _ in range(380)], words)
    fresh = [b"tk-" + code("abcdef0123456789", rng.randint(12, 40)) for _ in range(200)]
    assert loose.recall >= 0.9 and sum(map(loose.accepts, fresh)) >= 180 and not any(loose.accepts(w) for w, _ in words)
    # few examples still make an automaton, with less certainty
    few = secrets.FormatAutomaton(hexes[:3], words)
    assert sum(map(few.accepts, hexes[3:])) >= 60 and few.added_words == 0


def test_scan_equals_scoring_every_run(spark):
    rng = random.Random(22)
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 40])))
    texts = ["".join(rng.choice([f" token={code()} ", f" bare {code()}, ", " überall words stand 4024007187564873 here ", f"({code()[:30]})"]) for _ in range(6)) for _ in range(60)]
    prose = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(6, 11))) for _ in range(300)]
    texts = [t + " ".join(rng.choices(prose, k=4000)) for t in texts]  # what the background is made of
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    automata = secrets.infer_formats(docs)
    got = {r.doc_id: r.s for r in secrets.secret_spans(docs, "s", automata).collect()}
    added = 0
    for k, text in enumerate(texts):
        base = [(s.start, s.end) for s in got[k].base]
        want = []
        for m in re.finditer("[A-Za-z0-9+/_.=-]{6,}", text):
            if not any(s < m.end() and m.start() < e for s, e in base):
                kinds = [(a.likelihood(m[0].encode()), kind) for kind, a in automata.items() if a.accepts(m[0].encode())]
                want += [(f"format_{max(kinds)[1]}", m.start(), m.end())] if kinds else []
        assert [(s.kind, s.start, s.end) for s in got[k].spans if s.kind.startswith("format")] == want
        added += len(want)
    assert added > 10


def test_secret_spans_added_by_format(spark, awkward, nothing):
    rng = random.Random(3)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20))
    rows = [(k, f"é password={value()} rest") for k in range(60)] + [(100, f"é bare {value()} rest"), (101, "clean text of 2024 words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    automata = secrets.infer_formats(docs)
    got = {r.doc_id: r.s for r in secrets.secret_spans(docs, "s", automata).collect()}
    assert [(s.kind, s.start, s.end) for s in got[100].spans] == [("format_assign", 7, 27)] and got[100].base == [] and got[101].spans == []
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()}[100] == "é bare [SECRET] rest"
    masked = secrets.redact(awkward)
    rows = {r.text: r for r in masked.collect()}
    hit = next(r for t, r in rows.items() if t and "[SECRET]" in t)
    assert masked.columns == awkward.columns and hit.n_chars == len(hit.text) and None in rows and secrets.redact(nothing).count() == 0


def test_likelihood_alone_decides_on_candidates(spark):
    rng = random.Random(12)
    code = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    digits, long = [code("0123456789", 8) for _ in range(60)], [code("0123456789abcdef", 200) for _ in range(40)]
    words = " ".join(["ordinary words stand around everything written here."] * 20)
    rows = [f"{words} password = {d}" for d in digits] + [f"{words} {v}" for v in long] + [f"{words} 48151623 more"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    automata = secrets.infer_formats(docs)
    assert automata.keys() == {"assign", "hex"}
    got = secrets.secret_spans(docs, "f", automata).where("doc_id = 100").first().f.spans
    assert [(s.kind, s.start, s.end) for s in got] == [("format_assign", len(words) + 1, len(words) + 9)]


def test_all_values_and_words_are_learned_from(spark):
    rng = random.Random(31)
    code = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    marked = lambda: code("abcdefXYZ0123456789+/", rng.randint(8, 24))
    values = [code("0123456789abcdef", 20) for _ in range(900)] + [marked() for _ in range(300)] + ["s3-" + code("0123456789", 8) for _ in range(30)] + [code("abcdef0123456789", 700)]
    words = [code("aeioulnrst", rng.randint(6, 12)) for _ in range(9_000)] + [code("0123456789abcdef", 20) for _ in range(60)]
    dealt = rng.choices(words, k=30_000) + words
    rows = [(k, f"token={v} " + " ".join(dealt[k :: len(values)])) for k, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = secrets.infer_formats(docs)
    counts = collections.Counter(w.encode() for w in dealt)
    want = secrets.FormatAutomaton(sorted({v.encode() for v in values}), sorted(counts.items()))
    assert got["assign"].background.n_words == len(dealt) and got["assign"].background.logs == want.background.logs
    assert 0 < want.least_ratio and 0 < want.recall < 1 and want.added_words > 0 and want.unbounded
    for name in ("size", "lengths", "unbounded", "low", "high", "least_ratio", "recall", "added_words"):
        assert getattr(got["assign"], name) == getattr(want, name), name
    for value in (*values[::7], *words[::50], values[-1] + "0"):
        assert got["assign"].likelihood(value.encode()) == want.likelihood(value.encode())
    # every trained value goes through the root, and every symbol is left by some state
    trained = [v.encode() for v in values if not secrets.is_held(v.encode())]
    states = secrets.prefix_tree(trained).states()
    assert states[0].passed == len(trained) and sum(s.passed - s.ended for s in states) == sum(map(len, trained))


def test_likelihood_without_a_value_is_that_of_all_others():
    rng = random.Random(34)
    code = lambda n: b"".join(rng.choice([b"%x" % d for d in range(16)]) for _ in range(n))
    values = sorted({b"tk-" + code(rng.randint(12, 40)) for _ in range(150)} | {code(9) + b"/" + code(4), b"tk-" + b"z" * 800})
    plain = secrets.FormatAutomaton.of_tree(secrets.prefix_tree(values), support=10**9)  # nothing merges
    merged = secrets.FormatAutomaton.of_tree(secrets.prefix_tree(values))
    assert merged.size < plain.size
    for k in [*range(0, len(values), 9), values.index(b"tk-" + b"z" * 800)]:
        others = values[:k] + values[k + 1 :]
        want = secrets.FormatAutomaton.of_tree(secrets.prefix_tree(others), support=10**9)
        assert plain.without(values[k]) == pytest.approx(want.likelihood(values[k]))
        # the merged states, counted again from the others
        again = object.__new__(secrets.FormatAutomaton)
        again.states, again.folded, again.differing = [secrets.State() for _ in range(merged.size)], list(range(merged.size)), set()
        for other in others:
            at = 0
            for c in other:
                state, at = again.states[at], merged.steps[at][c][1]
                state.arcs[state.leave(c, 1)] = at
            again.states[at].end(1)
        again._weigh()
        assert merged.without(values[k]) == pytest.approx(again.likelihood(values[k]))
    assert any(plain.without(v) > -math.inf for v in values) and plain.without(b"tk-" + b"z" * 800) == -math.inf


def test_no_value_is_left_out_of_formats_and_bounds(spark):
    rng = random.Random(35)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    # the length 22 comes up among values of one share only
    values = [code(20) for _ in range(300)] + [v for v in (code(22) for _ in range(200)) if secrets.is_held(v.encode())][:8]
    docs = spark.createDataFrame([(k, f"token={v} ordinary words everything written") for k, v in enumerate(values)], "doc_id bigint, text string")
    found = secrets.infer_formats(docs)["assign"]
    assert found.lengths == {20, 22} and found.recall == 1
    every = secrets.FormatAutomaton.of_tree(secrets.prefix_tree([v.encode() for v in values]))
    scores = [every.without(v.encode()) for v in values]
    assert found.low == min(scores) - secrets.SLACK and found.high == max(*scores, *(every.likelihood(v.encode()) for v in values)) + secrets.SLACK


def test_values_of_rare_shapes_keep_their_ends():
    rng = random.Random(33)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    made = lambda: ("eyJ" + ".".join("".join(rng.choices(alphabet, k=rng.randint(20, 60))) for _ in range(3))).encode()
    automaton = secrets.FormatAutomaton([made() for _ in range(1_500)], [(b"everything", 500), (b"thornted", 700)])
    fresh = [made() for _ in range(200)]
    assert automaton.size < 1_000 and automaton.recall >= 0.9 and sum(map(automaton.accepts, fresh)) >= 180 and not automaton.accepts(b"everything")


def test_bound_of_words_is_exact(spark):
    rng = random.Random(32)
    ratios = [(kind, rng.choice([rng.random(), rng.random() * 1e-9, 3.0, rng.random() * 40]), rng.random() < 0.5, rng.randint(1, 5)) for kind in ("assign", "hex") for _ in range(700)]
    table = spark.createDataFrame([(k, secrets._bits(r), i, n) for k, r, i, n in ratios], "kind string, bits bigint, inside boolean, n bigint")
    for left in (0.5, 1.0, 37.0, 900.5, 1e6):
        want = {}
        for kind in ("assign", "hex"):
            passed = 0
            for r, n in sorted(((r, n) for k, r, _, n in ratios if k == kind), reverse=True):
                passed += n
                if passed > left:
                    want[kind] = r
                    break
        assert secrets.least_ratios(table, left) == want


# ------------------------------------------------------------------ 7
def test_longest_matches_with_places(spark, awkward, nothing):
    item = [f"b{k}" for k in range(15)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(item) + " z"), (2, " ".join(item[:9])), (3, " ".join(item[2:13]).upper() + " q tiny bench"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "tiny bench"), (9, None), (None, "x y"), (10, "")], "item_id bigint, text string")
    for words in (2_000_000, 4):
        got = {r.doc_id: r.m for r in decontaminate.suffix_matches(docs, items, "m", block_words=words).collect()}
        assert [tuple(m) for m in got[1].matches] == [(None, 0, 0, 2), ("7", 0, 2, 15)] and got[1].n_hit == 17 and got[2].n_hit == 0
        assert sorted(tuple(m) for m in got[3].matches) == [("7", 2, 0, 11), ("8", 0, 12, 2)] and got[3].n_hit == 13 and got[4].n_words == 0
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()) == [2, 4]
    assert decontaminate.remove_contaminated(awkward, items).columns == awkward.columns
    assert decontaminate.remove_contaminated(awkward, items.limit(0)).count() == awkward.count() and decontaminate.remove_contaminated(nothing, items).count() == 0


# ------------------------------------------------------------------ 8
def test_disclosing_terms_are_generalised_or_removed(spark, awkward, nothing):
    rows = [(k, f"Contact Zebulon about it: info@firm.example.com in house {k}") for k in range(5)] + [(10 + k, f"Contact people about weather in house number {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r for r in privacy.private_spans(docs).collect()}
    assert {s.value for s in spans[0].terms} == {"zebulon"} and spans[0].terms[0].kind == "removed" and spans[11].terms == []
    assert {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}[1] == "Contact  about it: [EMAIL] in house 1"
    clean = privacy.sanitise(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() and privacy.sanitise(nothing).count() == 0
    assert any("[EMAIL] or [IP]" in (r.text or "") for r in clean.collect())


def test_disclosing_terms_anywhere_in_their_documents(spark):
    far = "of all the people in this house " * 3
    held = [(k, f"ZEBULON of R2D7 {far}zebulon@x.org and {far}Zebulon, bob signed") for k in range(5)]
    docs = spark.createDataFrame(held + [(10 + k, f"{far} and signed") for k in range(60)] + [(None, held[0][1])], "doc_id bigint, text string")
    for r in privacy.private_spans(docs).collect():
        want = [(m, held[0][1].index(m)) for m in ("ZEBULON", "R2D7", "Zebulon", "bob")] if r.doc_id is None or r.doc_id < 10 else []
        assert [(s.value, s.start, s.end, s.kind) for s in r.terms] == [(m.lower(), at, at + len(m), "removed") for m, at in want]
    assert f" of  {far}[EMAIL] and {far},  signed" in [r.text for r in privacy.sanitise(docs).collect()]


def test_private_patterns_on_hard_strings(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("0123456789.@+- ()ab_é\U0001F600") for _ in range(rng.choice([5, 40, 150]))) for _ in range(400)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1 " * 9_000, "a" * 20_000, "4111-1111-1111-1111"]
    from tests.llm.test_queries import private_model

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in frame.select("doc_id", privacy.base_spans(F.col("text")).alias("spans")).collect()}
    assert all(got[k] == [x for _, x in private_model(t)] for k, t in enumerate(texts))


def test_privacy_runs_no_python(spark, awkward):
    plan = privacy.private_spans(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ 9
def test_automaton_matches_every_substring():
    rng = random.Random(6)
    for _ in range(100):
        rows = [[rng.randint(1, 3) for _ in range(rng.randint(0, 8))] for _ in range(3)]
        automaton, text = licences.SuffixAutomaton(rows), [rng.randint(1, 3) for _ in range(12)]
        inside = {tuple(r[i:j]) for r in rows for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        longest = [max(k for k in range(e + 1) if not k or tuple(text[e - k : e]) in inside) for e in range(13)]
        want = [(e, longest[e]) for e in range(1, 13) if longest[e] >= 2 and (e == 12 or longest[e + 1] != longest[e] + 1)]
        assert [(e, k) for e, k, _ in automaton.maximal_matches(text, 2)] == want


def test_overlapping_spans_keep_the_widest_without_comparing_all():
    def plain(spans):
        kept = []
        for span in sorted(spans, key=lambda s: (-s[5], -s[4], s[2], s[0], s[1])):
            if not any(k[2] < span[3] and span[2] < k[3] and (k[0] == span[0] or k[4:] != span[4:]) for k in kept):
                kept.append(span)
        return kept

    rng = random.Random(9)
    for _ in range(300):
        spans = []
        for _ in range(rng.randint(0, 40)):
            start, covered = rng.randint(0, 60), rng.randint(1, 4)
            spans.append((rng.choice("abc"), rng.randint(0, 3), start, start + rng.randint(1, 12), covered / 4, covered))
        assert licences._widest(spans) == plain(spans)
    began = time.time()
    assert len(licences._widest([("mit", 0, 20 * k, 20 * k + 12, 1.0, 12) for k in range(100_000)])) == 100_000 and time.time() - began < 10


def test_licences_on_awkward_rows(spark, awkward, nothing):
    text = "Released under the MIT\nLicense. This work is licensed under the old GNU General Public License, version 3."
    got = licences.license_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "f").first().f
    assert got.labels == ["gpl", "gpl-3.0", "mit"] and got.base_labels == ["gpl"] and got.score == 1.0
    rows = licences.license_spans(awkward, "f").collect()
    assert next(r.f for r in rows if r.doc_id == 4).score == 0.0 and next(r.f for r in rows if r.doc_id == 10 and "cc by" in r.text).base_labels == ["cc-by"]
    assert licences.license_spans(nothing, "f").count() == 0


def test_licence_bodies_without_their_opening(spark):
    whole = dict(licences.TEXTS)
    assert {"isc", "unlicense", "lgpl-2.1", "lgpl-3.0", "gpl-3.0", "epl-1.0", "cc-by-sa-4.0"} <= whole.keys()
    texts = {label: "\n".join(f"# {x}" for x in text.split("\n")) for label, text in whole.items()}
    lines = whole["mit"].split("\n")
    texts["mit body"] = "code\n" + "\n".join(lines[len(lines) // 2 :]) + "\nmore code"
    words = whole["apache-2.0"].split()
    texts["apache-2.0 body"] = " ".join(words[700:760] + ["and", "changed"] + words[762:900])
    texts["agpl-3.0 notice"] = "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"
    frame = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r.f for r in licences.license_spans(frame, "f").collect()}
    for name in texts:
        assert name.split()[0] in got[name].labels, name
    assert got["gpl-3.0"].labels == ["gpl", "gpl-3.0"] and got["isc"].labels == ["isc"] and got["mit body"].labels == ["mit"]
    [span] = got["apache-2.0 body"].spans
    assert (span.doc_start, span.doc_end) == (0, got["apache-2.0 body"].n_words) and got["apache-2.0 body"].score > 0.8


def test_chains_go_on_from_any_place_of_a_run(spark):
    template = "a b c one two three a b c four five six seven eight nine ten"
    text = "one two three a b c four five x seven eight nine ten"
    got = licences.license_spans(spark.createDataFrame([(text,)], "text string"), "f", templates=(("t", template),), min_covered=0.7).first().f
    assert [(s.label, s.doc_start, s.doc_end) for s in got.spans] == [("t", 0, 13)] and got.score == 12 / 16


# ------------------------------------------------------------------ 10
def removal_model(texts, size):
    first = {}
    for doc in sorted(texts):
        words = texts[doc].split()
        for k in range(len(words) - size + 1):
            first.setdefault(tuple(words[k : k + size]), doc)
    out = {}
    for doc, text in texts.items():
        words = text.split()
        gone = {k + j for k in range(len(words) - size + 1) if first[tuple(words[k : k + size])] < doc for j in range(size)}
        out[doc] = " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


@pytest.mark.parametrize("hot", [{"hot_rows": 5_000}, {"hot_rows": 2}])
def test_removal_against_brute_force(spark, hot):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(30)]
    texts = {k: " ".join([rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))] + passage[rng.randint(0, 9) : rng.randint(10, 30)] + [rng.choice("ab") for _ in range(8)]) for k in range(40)}
    texts |= {k: " ".join((["x", "y", "z"][: 1 + k % 3] * 40)[: rng.randint(3, 70)] + passage[:7] + ["x", "y"] * rng.randint(0, 20)) for k in range(40, 70)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.left.kept for r in debruijn.remove_repeated(frame, "left", size=6, minimizer=3, **hot).collect()}
    assert got == removal_model(texts, 6)


def test_texts_under_one_doc_id_stay_apart(spark):
    """Two texts of one id, whose CRCs agree in their last 16 bits, one with a passage of an earlier document."""
    passage = " ".join(f"w{k}" for k in range(30))
    longer = f"{' '.join(f'a{k}' for k in range(200))} {passage}"
    short = next(t for k in itertools.count() if (zlib.crc32((t := f"short text {k}").encode()) ^ zlib.crc32(longer.encode())) & 0xFFFF == 0)
    frame = spark.createDataFrame([(1, passage), (2, longer), (2, short)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.left.n_words, r.left.n_removed) for r in debruijn.remove_repeated(frame, "left").collect())
    assert got == [(1, 30, 0), (2, 3, 0), (2, 230, 30)]


def test_paths_are_verified_by_their_source_coordinates(spark):
    """A path whose words aren't those of its source is left alone; the others stay."""
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x a b c d e y z")], "doc_id bigint, text string")
    ids = {r.doc_id: r.text_id for r in debruijn._texts(docs).collect()}
    rows = [(2, ids[2], 1, 3, 1, ids[1], 0, False), (2, ids[2], 4, 2, 1, ids[1], 3, False), (2, ids[2], 1, 5, 1, ids[1], 0, True)]
    paths = spark.createDataFrame(rows, debruijn.PLACES)
    got = debruijn.verified(docs, paths, debruijn.Workspace(spark), 3).collect()
    assert sorted(tuple(r) for r in got) == sorted([rows[0], rows[2]])


def test_removal_on_awkward_rows(awkward, nothing):
    rows = debruijn.remove_repeated(awkward, "left").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == awkward.count() and by[1][0].left.n_removed == 0 and all(r.left.kept == "" for r in by[2]) and by[4][0].left.n_words == 0
    assert all(r.left.n_removed == 0 for r in by[None]) and by[7][0].left.n_removed == 0 and debruijn.remove_repeated(nothing, "left").count() == 0


# ------------------------------------------------------------------ long and broken inputs
def test_malformed_records_get_a_status(spark, tmp_path):
    good = warc.records_of(7, 1, "http://a", b"hello", 5, warc.digest(b"hello"), None, 1000, 100)[0] + b"\r\n\r\n"
    broken = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nbody\r\n\r\n"
    strange = good.replace(b"http://a", b"http://\xff").replace(b"X-Page-ID: 7", b"X-Page-ID: seven")
    torn = good[: len(good) - 20]
    (tmp_path / "a.txt").write_bytes(b"garbage\r\n" + broken + strange + good + torn)
    got = [(r.page_id, r.payload, r.status) for r in warc.read_archives(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(None, None, "no length"), (None, None, "broken x-page-id"), (7, b"hello", "ok"), (7, None, "torn record")], key=repr)


def test_many_spans_of_one_text_are_found_in_order(spark):
    text = " ".join(f"né{k}@example.org" for k in range(3_000))
    began = time.monotonic()
    spans = spark.createDataFrame([(1, text)], "doc_id bigint, text string").select(privacy.base_spans(F.col("text")).alias("s")).first().s
    assert time.monotonic() - began < 60
    model = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s.start, s.end, s.value) for s in spans if s.kind == "email"] == model


def test_places_of_secrets_in_code_points():
    text = "é" * 10 + " " + " ".join(f"password: 'ünter{k}abc{k}' " for k in range(50))
    [(base, _)] = secrets._scan([text.encode()], {})
    assert [(s, e) for k, s, e, _ in base if k == "assign"] == [(m.start(), m.end()) for m in re.finditer(r"(?i)(password)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    taken = [(5, 9), (5, 30), (12, 14)]
    words = b"aaaaaa bbbbbbbbbb cccccccccccccccc dddddddd eeeeeeee"
    assert [c[2] for c in secrets._candidates(words, taken)] == [m[0] for m in secrets._CANDIDATE.finditer(words) if not any(s < m.end() and m.start() < e for s, e in taken)]


def test_periodic_items_and_texts(spark):
    item = " ".join(["a", "b", "c"] * 400)
    docs = spark.createDataFrame([(1, " ".join(["a", "b", "c"] * 5_000)), (2, "x " + " ".join(["b", "c", "a"] * 4)), (3, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, item), ("q", "x b c")], "item_id string, text string")
    got = {r.doc_id: r.m for r in decontaminate.suffix_matches(docs, items, "m").collect()}
    assert (got[1].n_hit, got[2].n_hit, got[3].n_hit) == (15_000, 13, 0)
    assert {m.item_id for m in got[1].matches} == {None} and {m.item_id for m in got[2].matches} == {None, "q"}
    assert len(got[1].matches) <= 15_000
