"""Operators without SQL, and the edge cases of the others, on small hand-made rows."""

import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from notewell.functions import text as T
from notewell.operators import bm25, editing, fragments, graph, maintenance, search, transcripts, vectors
from notewell.sources import notes as note_files
from notewell.sources import scratch
from notewell.sources.generations import Generations
from notewell.streaming import maintenance as streams


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_fold_matches_unicode_decomposition(spark):
    text = "ÉVÉNEMENT où ça Ñandú größe Ärger"
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    assert one(spark, T.fold(F.col("t")), t=text) == plain


def test_tokens_keep_compounds_and_parts(spark):
    assert one(spark, T.tokens(F.col("t")), t="ORA-01555 et unattended-upgrades, x 7 snake_case") == ["ora-01555", "ora", "01555", "unattended-upgrades", "unattended", "upgrades", "7", "snake_case", "snake", "case"]


def test_fragments_of_edge_notes(spark):
    long = "a" * 1801
    rows = [
        ("n/empty.md", "---\ntags: [x]\n---\n  \n"),
        ("n/short.md", "one line"),
        ("n/tags.md", "---\ntags: [alpha, 'beta']\naliases: gamma, alpha\n---\nBody"),
        ("n/heads.md", "intro\n# One\nfirst\n## Two\n- [[a]]\n- [[b]]\n# Three\nlast"),
        ("n/long.md", long),
    ]
    found = {}
    for r in fragments.fragments(spark.createDataFrame(rows, "path string, content string")).orderBy("path", "rank").collect():
        found.setdefault(r.path, []).append((r["rank"], r.title, r.text))
    assert "n/empty.md" not in found
    assert found["n/short.md"] == [(0, "short", "short one line"), (1, "", "one line")]
    assert found["n/tags.md"][0] == (0, "tags", "tags alpha beta gamma Body")
    assert [(k, t) for k, t, _ in found["n/heads.md"]] == [(0, "heads"), (1, ""), (2, "One"), (3, "Three")]
    assert [len(t) for _, _, t in found["n/long.md"]][1:] == [1000, 1000, 201]


def test_bm25_against_a_plain_model(spark):
    rows = [("a.md", 0, "", "red red blue"), ("b.md", 0, "", "blue green"), ("c.md", 0, "", "")]
    held = spark.createDataFrame(rows, "path string, rank int, title string, text string")
    got = {(r.path, r.term): r.weight for r in bm25.postings(bm25.term_counts(held)).collect()}
    docs = {p: (["a.md", "md"] if p == "a.md" else [p, *p.split(".")]) + t.split() for p, _, _, t in rows}
    docs["a.md"] = ["a.md", "md", "red", "red", "blue"]  # "a" is a stop word
    docs["b.md"], docs["c.md"] = ["b.md", "md", "blue", "green"], ["c.md", "md"]
    average = sum(map(len, docs.values())) / 3
    for path, words in docs.items():
        for term in set(words):
            df, tf = sum(term in d for d in docs.values()), words.count(term)
            want = math.log1p((3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
            assert abs(got[path, term] - want) < 1e-9


def test_vector_scores_by_mean_and_mix(spark):
    held = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 2, [0.8, 0.6])], "path string, row_idx int, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.path, r.score) for r in vectors.search(held, asked, 5).orderBy("position").collect()] == [("b", 0.8), ("a", 0.5)]
    assert [(r.path, r.score) for r in vectors.search(held, asked, 5, "mix").orderBy("position").collect()] == [("b", 0.8), ("a", 0.75)]


def test_fusion_prefers_lists_in_order_and_authority(spark):
    lists = [(1, 0, "raw/x.md", 1, 1.0, False), (1, 1, "notes/y.md", 1, 1.0, False), (2, 0, "raw/x.md", 1, 1.0, True), (2, 1, "notes/y.md", 1, 1.0, True)]
    frame = spark.createDataFrame(lists, "query_id int, list_no int, path string, position int, weight double, looks_back boolean")
    got = {(r.query_id, r.position): r.path for r in search.fused(frame, 5, 2.0).collect()}
    assert got[1, 1] == "notes/y.md" and got[2, 1] == "raw/x.md"


def test_queries_that_look_back(spark):
    assert one(spark, search.looks_back(F.col("t")), t="la Conversation d'hier") and not one(spark, search.looks_back(F.col("t")), t="pare-feu nginx")


def test_wikilinks_with_anchors_and_aliases(spark):
    notes = spark.createDataFrame([("n", "[[A]] [[ B |x]] [[C#h|y]] [[dir/D#z]] [[]]")], "path string, content string")
    assert [r.target for r in graph.wikilinks(notes).orderBy("position").collect()] == ["A", "B", "C", "dir/D"]


def test_link_rewriting_spares_code(spark):
    text = "[[Old]] [[Old#a|b]] [[Older]] `[[Old]]`\n```\n[[Old]]\n```\n[[Old|x]] [[ Old ]]"
    got = one(spark, editing.rewritten_links(F.col("t"), F.lit("Old"), F.lit("N$1\\")), t=text)
    assert (got.content, got.n) == (text.replace("[[Old]] [[Old#a|b]]", "[[N$1\\]] [[N$1\\#a|b]]").replace("[[Old|x]] [[ Old ]]", "[[N$1\\|x]] [[N$1\\]]"), 4)


def test_renames_rewrite_citing_notes_once_each(spark):
    notes = spark.createDataFrame([("c.md", "[[A]] [[B]] [[C]]"), ("d.md", "[[C]]"), ("e.md", "`[[A]]`")], "path string, content string")
    links = graph.wikilinks(notes)
    names = spark.createDataFrame([("x/A.md", "A"), ("B.md", "B"), ("C.md", "C"), ("y/C.md", "C")], "path string, name string")
    renames = spark.createDataFrame([("A", "A2"), ("B", "B2"), ("C", "C2")], "old string, new string")
    assert [tuple(r) for r in editing.renamed(notes, links, names, renames).collect()] == [("c.md", "[[A2]] [[B2]] [[C]]", 2)]


def test_document_spans_cover_and_overlap():
    random.seed(3)
    for size in (10, 999, 1000, 1001, 5000, 20000):
        text = "".join(random.choice(["word ", "x", "\n", "\n\n", "\n# Head\n"]) for _ in range(size))
        spans = editing.document_spans(text, 1500, 120)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a[0] < b[0] <= a[1] < b[1] or len(text) == 0 for a, b in zip(spans, spans[1:], strict=False))


def test_document_spans_end_at_the_best_boundary():
    """Brute force: try every cut of the upper half of a span, best kind first."""

    def cut(text, low, high):
        if high >= len(text):
            return len(text)
        half = low + max(1, (high - low) // 2)
        for mark, before in (("#", True), ("\n\n", False), ("\n", False), (" ", False)):
            for k in range(high - 1, half - 1, -1):
                if before:
                    found = re.compile(r"#{1,6}\s").match(text, k, high) and (k == half or text[k - 1] == "\n")
                else:
                    found = k + len(mark) <= high and text.startswith(mark, k)
                if found:
                    return k if before else k + len(mark)
        return high

    random.seed(8)
    for n in (0, 1, 900, 1001, 4000, 9000):
        text = "".join(random.choice(["word ", "x" * 300, "\n", "\n\n", "\n## Head\n", "# "]) for _ in range(n // 30 + (n > 0)))
        for size, overlap in ((1000, 0), (1500, 120), (1200, 900)):
            spans = editing.document_spans(text, size, overlap)
            assert [e for _, e in spans] == [cut(text, b, min(b + size, len(text))) for b, _ in spans] and spans[-1][1] == len(text)
            for (begin, end), (following, _) in zip(spans, spans[1:], strict=False):
                shared = cut(text, begin, max(begin + 1, end - min(overlap, size // 2)))
                assert following == (shared if shared > begin else end)


def test_compact_view_keeps_ends_and_budget():
    messages = [str(k) * 100 for k in range(9)]
    kept = transcripts.compact_view(messages, 500)
    assert kept[0] == 0 and kept[-1] == 8 and sum(len(messages[k]) for k in kept) <= 500 and len(kept) > 2
    assert transcripts.compact_view(messages, 10_000) == list(range(9)) and transcripts.compact_view([], 5) == []


def test_code_is_encapsulated():
    text, n = transcripts.encapsulate_code("a\n```sh\nrm -rf\n```\nb\n- ~~~\nx\n~~~\n")
    assert n == 2 and "[DATA 1" in text and "[END DATA 2]" in text


def test_redactions_by_family(spark):
    text = "sk-abcdefghijklmnop1234 and password: hunter22 and mdp = <REDACTED_PASSWORD> and https://u:p@h/x and the password policy"
    got = one(spark, transcripts.redacted(F.col("t")), t=text)
    assert got == "<REDACTED_API_KEY> and <REDACTED_PASSWORD> and mdp = <REDACTED_PASSWORD> and https://<REDACTED_CREDENTIALS>@h/x and the password policy"


def test_paths_are_normalised_or_refused(spark):
    rows = ["a/./b.md", "a/../b.md", "../x.md", "/abs.md", "C:\\x.md", "_secret.md", "a.txt", "", None]
    got = {r.path: (r.normal, r.reason) for r in editing.normalised_paths(spark.createDataFrame([(r,) for r in rows], "path string")).collect()}
    assert got["a/./b.md"] == ("a/b.md", None) and got["a/../b.md"] == ("b.md", None)
    assert [got[r][1] for r in rows[2:]] == ["escapes", "absolute", "windows path", "reserved", "not markdown", "empty", "empty"]


def test_frontmatter_and_append(spark):
    fields = one(spark, editing.frontmatter_fields(F.col("t")), t='---\ntitle: "A: b"\n  nested: no\ntags: x\n---\nbody: z')
    assert fields == {"title": "A: b", "tags": "x"}
    assert one(spark, editing.appended(F.col("a"), F.col("b")), a="x\n\n", b="\ny") == "x\ny"


def test_incremental_equals_full_rebuild(spark):
    before = spark.createDataFrame([("a.md", "one"), ("b.md", "two"), ("c.md", "three")], "path string, content string")
    after = spark.createDataFrame([("a.md", "one"), ("b.md", "changed"), ("d.md", "new")], "path string, content string")
    changed = spark.createDataFrame([("b.md", False), ("c.md", True), ("d.md", False)], "path string, deleted boolean")
    edited = after.join(changed.where("not deleted"), "path").select("path", "content")
    got = maintenance.reindexed(fragments.fragments(before), changed, fragments.fragments(edited))
    assert sorted(got.collect()) == sorted(fragments.fragments(after).collect())


def test_stream_of_changes_publishes_generations(spark, tmp_path):
    root, folder = str(tmp_path / "index"), tmp_path / "changes"
    folder.mkdir()
    store = Generations(spark, root)
    start = spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "path string, content string")
    store.publish({"fragments": fragments.fragments(start)}, 5)
    rows = [{"path": "a.md", "content": "first", "deleted": False, "seq": 1}, {"path": "a.md", "content": "last", "deleted": False, "seq": 2}, {"path": "b.md", "deleted": True, "seq": 3}, {"path": "c.md", "seq": 4}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    streams.run_index(spark, str(folder), root, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.current() == 6
    want = fragments.fragments(spark.createDataFrame([("a.md", "last")], "path string, content string"))
    assert sorted(store.read("fragments").collect()) == sorted(want.collect())
    store.publish({"fragments": want}, 1)
    assert store.current() == 7 and store.purge(1) == [5, 6]


def test_large_batches_of_changes_are_published(spark, tmp_path):
    root, folder = str(tmp_path / "index"), tmp_path / "changes"
    folder.mkdir()
    store = Generations(spark, root)
    store.publish({"fragments": fragments.fragments(spark.createDataFrame([("a.md", "one")], "path string, content string"))}, 1)
    (folder / "1.json").write_text("\n".join(json.dumps({"path": f"{k}.md", "content": f"note {k}", "deleted": False, "seq": k}) for k in range(2_500)))
    streams.run_index(spark, str(folder), root, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read("fragments").select("path").distinct().count() == 2_501


def test_session_windows_merge_at_the_gap(spark):
    rows = [("s", 0, "ok"), ("s", 900, "ok"), ("s", 1801, "tool_error")]
    calls = spark.createDataFrame(rows, "session string, t int, outcome string").withColumn("started_at", F.timestamp_seconds("t"))
    got = sorted((r.calls, r.errors) for r in streams.session_windows(calls).collect())
    assert got == [(1, 1), (2, 0)]  # only a gap of more than 900 seconds parts two sessions


def test_notes_are_read_from_files(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "a.md").write_bytes(b"x\r\ny\xff")
    (tmp_path / "index.md").write_text("no")
    (tmp_path / "b.txt").write_text("no")
    got = note_files.read_notes(spark, str(tmp_path)).collect()
    assert [(r.path, r.content) for r in got] == [("wiki/a.md", "x\ny\ufffd")]
    assert note_files.read_note(spark, str(tmp_path), "wiki/a.md").first().content == "x\ny\ufffd"


def test_large_files_keep_a_row_with_the_reason(spark, tmp_path):
    (tmp_path / "big.md").write_bytes(b"x" * (9 * 1024 * 1024))
    (tmp_path / "small.md").write_text("ok")
    got = {r.path: (r.content, r.reason) for r in note_files.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"small.md": ("ok", None), "big.md": (None, "larger than 8388608 bytes: 9437184")}


def test_a_broken_publish_leaves_the_old_generation(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "index"))
    one_row = spark.createDataFrame([("a",)], "path string")
    store.publish({"t": one_row}, 1)

    class Broken(Generations):
        def _commit(self, number):
            assert Generations(self.spark, self.root).current() == 1
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        Broken(spark, store.root).publish({"t": one_row.limit(0)}, 2)
    assert store.current() == 1 and store.read("t").count() == 1
    assert store.publish({"t": one_row.limit(0)}, 2) == 2 and store.read("t").count() == 0


def test_a_repeated_batch_publishes_once(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "index"))
    store.publish({"fragments": fragments.fragments(spark.createDataFrame([("a.md", "one")], "path string, content string"))}, 1)
    batch = spark.createDataFrame([("a.md", "two", False, 1)], streams.CHANGES)
    for _ in range(2):
        streams.index_writer(store)(batch, 0)
    assert store.current() == 2 and store.applied() == 0


def test_a_cluster_session_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(scratch.NoSharedFolder):
        scratch.shared_folder(Session())
