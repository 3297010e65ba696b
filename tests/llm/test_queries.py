"""The opN queries against DuckDB, and those without SQL against brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest

from notewell.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_all_thirteen_are_registered():
    assert {k.split("_")[0] for k in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, duck, key):
    frame = catalog.QUERIES[key](spark, DATA)
    columns = sorted(frame.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(catalog.ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert ours == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secret_model(text):
    found = []
    kinds = (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    for place, (kind, pattern, fits) in enumerate(kinds):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}", kind) for m in re.finditer(pattern, text) if fits(m)]
    return sorted(found)


def test_secrets_against_plain_patterns(spark, texts):
    for r in catalog.QUERIES["op6_secrets"](spark, DATA).collect():
        want = secret_model(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(x[2] for x in want))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in want) for k in ("assign", "access", "hex"))
        assert {x[2] for x in want} <= set(r.spans.split(","))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private_model(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(kind, f"{kind}:{m.start()}:{m.end()}") for kind, pattern, fits in kinds for m in re.finditer(pattern, text) if fits(m)]


def test_private_data_against_plain_patterns(spark, texts):
    for r in catalog.QUERIES["op8_privacy"](spark, DATA).collect():
        want = private_model(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(x[1] for x in want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone"))
        assert r.spans == "" or want


def test_licences_against_plain_phrases(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in catalog.QUERIES["op9_licences"](spark, DATA).collect():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((k for k, _ in places), default=None) and r.last_word == max((k for k, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_quality_is_learned_for_the_held_out_fold(spark, duck):
    scored = {r.doc_id: r for r in catalog.QUERIES["op5_ranking"](spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())
    held = [(scored[i], q) for i, q in labels if scored[i].held_out]
    assert sum(r.predicted == q for r, q in held) >= 0.95 * len(held)
