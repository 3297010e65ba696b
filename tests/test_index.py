"""Index maintenance by retraction, the streams that feed it, and reconciliation with a mirror."""

import json
import random
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from notewell import catalog
from notewell.functions import text, words
from notewell.operators import bm25, graph, indexing
from notewell.sources import generations, scratch
from notewell.operators.fragments import fragments
from notewell.sources.generations import Generations
from notewell.streaming import maintenance as streams
from notewell.streaming import reconciliation

NOTE = "path string, content string"
CHANGE = "path string, content string, deleted boolean"


def state(store):
    """All tables of the current generation as sorted rows."""
    return {name: sorted(map(tuple, store.read(name).collect()), key=repr) for name in store.manifest()["tables"]}


def rebuilt(spark, notes, root):
    store = Generations(spark, str(root))
    indexing.build(store, spark.createDataFrame(sorted(notes.items()), NOTE), 1)
    return state(store)


def test_any_batches_give_the_tables_of_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "unattended-upgrades", "[[a]]", "[[b|x]]", "[[c#y]]", "the"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
    notes = {f"n/{k}.md": text() for k in range(12)}
    store = Generations(spark, str(tmp_path / "index"))
    indexing.build(store, spark.createDataFrame(sorted(notes.items()), NOTE), 10)
    for turn in range(4):
        batch = []
        for path in rng.sample([f"n/{k}.md" for k in range(16)], 5):
            if rng.random() < 0.3:
                notes.pop(path, None)
                batch.append((path, None, True))
            else:
                notes[path] = text()
                batch.append((path, notes[path], False))
        indexing.apply(store, spark.createDataFrame(batch, CHANGE), {"s": turn}, max_deltas=3)
        assert len(store.manifest()["deltas"]) == (turn + 1) % 3
    assert state(store) == rebuilt(spark, notes, tmp_path / "other")
    counts = store.read("frequency").where("term = 'alpha'").first()
    plain = store.read("terms").where("term = 'alpha'").count()
    assert (counts.df if counts else 0) == plain and store.applied("s") == 3
    assert store.purge(1) and state(store) == rebuilt(spark, notes, tmp_path / "third")
    assert bm25.search(store.read("terms"), spark.createDataFrame([(1, "alpha beta")], "query_id int, query string"), 5).count() > 0


def test_everything_deleted_and_nothing_changed(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "index"))
    indexing.build(store, spark.createDataFrame([("a.md", "one [[b]]")], NOTE), 1)
    indexing.apply(store, spark.createDataFrame([("a.md", None, True), ("never.md", None, True)], CHANGE))
    held = state(store)
    assert held["fragments"] == held["terms"] == held["edges"] == held["frequency"] == held["targets"] == [] and held["totals"] == [(0, 0)]


def dropped(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"path": p, "content": c, "deleted": c is None, "seq": k}) for k, (p, c) in enumerate(rows)))


def paths(store):
    return {r.path for r in store.read("fragments").select("path").distinct().collect()}


def test_two_streams_and_a_deleted_checkpoint_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    store = Generations(spark, root)
    indexing.build(store, spark.createDataFrame([("a.md", "one")], NOTE), 1)
    first, second = tmp_path / "first", tmp_path / "second"
    for k in range(3):
        dropped(first, str(k), (f"f{k}.md", f"first {k}"))
        streams.run_index(spark, str(first), root, str(tmp_path / "c1")).awaitTermination()
    assert paths(store) == {"a.md", "f0.md", "f1.md", "f2.md"}
    for k in range(2):
        dropped(second, str(k), (f"m{k}.md", f"second {k}"))
        streams.run_index(spark, str(second), root, str(tmp_path / "c2")).awaitTermination()
    assert paths(store) >= {"m0.md", "m1.md"}
    shutil.rmtree(tmp_path / "c2")
    dropped(second, "9", ("m9.md", "later"), ("m0.md", None))
    streams.run_index(spark, str(second), root, str(tmp_path / "c2")).awaitTermination()
    assert "m9.md" in paths(store) and len(store.manifest()["streams"]) == 3


def test_a_repeated_batch_of_a_stream_changes_nothing(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "index"))
    indexing.build(store, spark.createDataFrame([("a.md", "one")], NOTE), 1)
    batch = spark.createDataFrame([("a.md", "two words", False, 1)], streams.CHANGES)
    for stream in ("x", "x", "y"):
        streams.index_writer(store, stream)(batch, 0)
    assert store.manifest()["streams"] == {"x": 0, "y": 0} and len(store.manifest()["deltas"]) == 2
    assert [r.df for r in store.read("frequency").where("term = 'two'").collect()] == [2]  # identity and window


# ------------------------------------------------------------------ reconciliation
MIRROR = "path string, change_ns bigint, modified_ns bigint"


def test_gaps_compare_paths_and_inclusive_times(spark):
    mirror = spark.createDataFrame([("new", 1, 1), ("same", 5, 5), ("equal", 10, 3), ("touched", 4, 11), ("unknown", None, None), ("late", 3, 3), ("late", 12, 1), (None, 99, 99)], MIRROR)
    index = spark.createDataFrame([(p,) for p in ("same", "equal", "touched", "unknown", "late", "gone", "gone")], "path string")
    found = {r.path: r.reason for r in reconciliation.gaps(mirror, index, 10).collect()}
    assert found == {"new": "created", "gone": "removed", "equal": "written", "touched": "written", "late": "written"}
    assert {r.path for r in reconciliation.gaps(mirror, index, 0).collect()} == {"new", "gone"} == {r.path for r in reconciliation.gaps(mirror, index, None).collect()}
    assert reconciliation.gaps(mirror.limit(0), index.limit(0), 5).count() == 0


def test_the_mark_advances_after_complete_passes_only(spark, tmp_path):
    mark = reconciliation.Mark(spark, str(tmp_path / "mark"))
    mirror, index = spark.createDataFrame([("a", 100, 1), ("b", 30, 1), ("c", 1, 1)], MIRROR), spark.createDataFrame([("a",), ("b",)], "path string")
    queued = []
    keep = lambda found: queued.append({r.path for r in found.collect()})

    def broken(*_):
        raise OSError("lost")

    at = lambda ns: (lambda: ns)
    assert mark.read() == 0 and reconciliation.reconcile(mark, lambda: mirror, index, keep, clock=at(50)) == "complete"
    assert queued == [{"c"}] and mark.read() == 50
    for scan, queue in ((broken, keep), (lambda: mirror, broken)):
        with pytest.raises(OSError, match="lost"):
            reconciliation.reconcile(mark, scan, index, queue, clock=at(70))
    assert mark.read() == 50 and reconciliation.reconcile(mark, lambda: mirror, index, keep, most=1, clock=at(80)) == "too many" and mark.read() == 50
    assert reconciliation.reconcile(mark, lambda: mirror, index, keep, clock=at(100)) == "complete" and queued[-1] == {"a", "c"}
    # what is written just when a pass begins is seen by the next one too
    assert reconciliation.reconcile(mark, lambda: mirror, index, keep, clock=at(120)) == "complete" and queued[-1] == {"a", "c"} and mark.read() == 120
    # the clock went back: the mark is ignored once, then set anew
    assert reconciliation.reconcile(mark, lambda: mirror, index, keep, clock=at(60)) == "complete" and queued[-1] == {"c"} and mark.read() == 60


def test_edges_are_distinct_links(spark):
    notes = spark.createDataFrame([("a.md", "[[x]] [[x#y]] [[z|t]]"), ("b.md", None)], NOTE)
    assert sorted(map(tuple, indexing.edges(notes).collect())) == [("a.md", "x"), ("a.md", "z")]
    assert graph.wikilinks(notes).count() == 3 and fragments(notes).where(F.col("path") == "b.md").count() == 0


def test_rows_meet_many_touched_paths_in_partitions_by_size(spark, tmp_path, monkeypatch):
    store = generations.Generations(spark, f"file://{tmp_path}/index")
    indexing.build(store, spark.createDataFrame([(f"n{k}.md", f"word{k} [[t{k % 3}]]") for k in range(400)], "path string, content string"), 1)
    indexing.apply(store, spark.createDataFrame([(f"n{k}.md", f"new{k}", k % 2 == 0) for k in range(0, 400, 4)] + [("n1.md", "new1", False)], "path string, content string, deleted boolean"))
    want = sorted(map(tuple, store.read("terms").collect()))
    monkeypatch.setattr(generations, "TOUCHED_BYTES", 0)
    monkeypatch.setattr(scratch, "SLICE_BYTES", 200)
    dealt = store.read("terms")
    assert sorted(map(tuple, dealt.collect())) == want
    # touched paths are among the files that the result names, but not among the rows dealt
    assert dealt.rdd.getNumPartitions() > 100 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_notes_of_nearly_nothing_count_as_in_sql(spark, tmp_path):
    """Notes of a lone link, of what looks like Markdown, without text, with other white space and letters, and ids below 0."""
    long = "mot " * 400
    texts = ["", None, "#", "# Title\nbody", "---\na: b\n---\nrest", "-", "\n\n", "\x0bx\x0b", "Vi\u1ec7t na\u00efve x\u00bdy \u24d0b e\u0301t\u0301", f"\x85{long}\x85", f"\u3000{long}\n## end", "a_b.c-d 7 q le"]
    ids = [*range(40), *range(-20, 0)]
    table = pa.table({"doc_id": ids, "text": [texts[k % len(texts)] for k in range(len(ids))], "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": [1] * len(ids)})
    pq.write_table(table, tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = duck.execute(f"SELECT kind, key, n FROM ({catalog.ORACLES['index_maintenance']})").fetchall()
    got = catalog.QUERIES["index_maintenance"](spark, str(tmp_path)).select("kind", "key", "n")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_counted_terms_are_the_tokens_of_a_column(spark):
    rows = [("The foo.bar-baz_q \u00c9t\u00e9 a_ _ 7 x ... -a.b- \u00e9x. [[t5]]",), (None,), ("",), ("le la",), ("Vi\u1ec7t e\u0301t x\u00bdy A.b a.b a__b",)]
    tokens = [sorted(r.t or []) for r in spark.createDataFrame(rows, "x string").select(text.tokens(F.col("x")).alias("t")).collect()]
    row, code, terms = words.terms(pa.array([r[0] for r in rows], pa.string()), text.STOP_WORDS)
    assert [sorted(terms[int(c)].as_py() for r, c in zip(row, code, strict=True) if r == k) for k in range(len(rows))] == tokens


def test_no_row_of_an_untouched_note_is_dealt_for_a_batch(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}/index")
    indexing.build(store, spark.createDataFrame([(f"n{k}.md", f"word{k}") for k in range(300)], NOTE), 1)
    indexing.apply(store, spark.createDataFrame([("n1.md", "new", False), ("n2.md", None, True)], CHANGE))
    paths = spark.createDataFrame([("n1.md",), ("n2.md",), ("n3.md",), ("none.md",)], "path string")
    held = store.read("terms", paths)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, store.read("terms").join(paths, "path", "left_semi").collect())) != []
    assert {r.path for r in held.collect()} == {"n1.md", "n3.md"}
