"""Spelling variants against a plain reading of the rule."""

import random
import re
import zlib

import pytest

from notewell.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, []
    met = {w: [o for o in words if near(w, o)] for w in words}
    for w, n in words.items():
        best = min(met[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(met[w]), words.get(form[w])))
    return sorted(out)


def crowd(seed):
    """Words that share long beginnings and endings, with typing errors of every kind and steep counts."""
    rng = random.Random(seed)
    letters = "abcé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "überfluß", "international"]
    pool = list(base)
    for word in base:
        for _ in range(14):
            i, c = rng.randrange(len(word) + 1), rng.choice(letters)
            pool.append(rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]]))
    texts = []
    for k in range(30):
        chosen = [w for j, w in enumerate(pool) for _ in range(rng.choice([0, 0, 1, 30 if j < 6 else 1]))]
        rng.shuffle(chosen)
        texts.append((k, rng.choice([" ", ", ", "7"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in chosen)))
    return texts


@pytest.mark.parametrize("limit", [spelling.GROUP_WORDS, 12, 2])
def test_variants_of_crowded_words(spark, limit):
    rows = crowd(limit)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_variants(rows)
    assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want) | (limit != 2)
    assert sorted((tuple(r) for r in spelling.variants(docs, limit).collect()), key=lambda r: r[0]) == want


def test_chains_of_forms_reach_the_last(spark):
    words = ["abcdefg"] * 2 + ["abcdefgh"] * 40 + ["abcdefghi"] * 900 + ["xbcdefghi"] * 9100
    docs = spark.createDataFrame([(None, " ".join(words))], "doc_id bigint, text string")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(docs).collect()}
    assert got["abcdefg"] == ("abcdefgh", "xbcdefghi", 1) and got["xbcdefghi"] == (None, "xbcdefghi", 1)


def test_automaton_numbers_words_in_order():
    words = sorted({"".join(random.Random(k).choices("abz", k=5 + k % 3)) for k in range(200)})
    automaton = spelling.WordAutomaton(words)
    for k, word in enumerate(words):
        state, number = automaton.walk(word, 0, automaton.root, 0)
        assert number == k and automaton.final[state]
        assert automaton.near(word, 2) == {j for j, o in enumerate(words) if o[:2] == word[:2] and near(word[2:], o[2:])}
    assert len(automaton.arcs) < sum(map(len, words)) / 2


def test_awkward_rows(spark, awkward, nothing):
    got = {r.word: r.n for r in spelling.variants(awkward).collect()}
    assert "epsilon" in got and "omicron" in got and "another" not in got
    assert spelling.variants(nothing).count() == 0 and spelling.variants(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]
