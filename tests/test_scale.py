"""Operators whose plan differs from their SQL: the rows stay DuckDB's, and no step pairs the rows of a group."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.operators import bm25, fragments, fresh, graph, packing, recordings, transcripts, vectors
from notewell.sources import scratch


def rows_of_both(spark, operator, **tables):
    """Spark's and DuckDB's rows of an operator on tables given as (schema, rows)."""
    frames = {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in tables.items()}
    duck = duckdb.connect()
    for name, (schema, rows) in tables.items():
        duck.execute(f"CREATE TABLE t_{name} ({schema.replace('string', 'varchar')})")
        if rows:
            duck.executemany(f"INSERT INTO t_{name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    made = operator(**frames)
    columns = sorted(made.columns)
    asked = duck.execute(f"SELECT {', '.join(columns)} FROM ({operator.oracle(**{k: f'SELECT * FROM t_{k}' for k in tables})})").fetchall()
    plain = lambda row: tuple(float(v) if isinstance(v, float) else v if v is None or isinstance(v, str) else int(v) for v in row)
    return sorted((plain(r[c] for c in columns) for r in made.collect()), key=repr), sorted(map(plain, asked), key=repr)


def test_projection_sizes_round_and_trim_as_duckdb_does(spark):
    texts = [(1, 1, "user", "x" * 1999), (1, 2, "system", "y"), (2, 1, "user", "\u00a0\u3000abc\u2003"), (2, 2, None, "\tab\n "), (3, 1, "user", None), (4, 1, "user", ""), (5, 1, "assistant", "\u00a0"), (5, 2, "user", "é" * 6001)]
    schema = "conv_id bigint, turn int, role string, text string"
    ours, theirs = rows_of_both(spark, transcripts.projection_stats, messages=(schema, texts))
    assert repr(ours).replace("-nan", "nan") == repr(theirs).replace("-nan", "nan") and [r[3] for r in ours if r[0] == 1] == [0.0]
    ours, theirs = rows_of_both(spark, transcripts.messages, messages=(schema, texts))
    assert ours == theirs


def page_rows(n):
    rng = random.Random(5)
    names = [(f"p{k}", rng.choice(["Die", "De", "Rare", "", None])) for k in range(n)] + [("p0", "Die"), (None, "De"), (None, None), ("p1", "De"), ("p1", "Die")]
    links = [(f"p{rng.randrange(n + 5)}", rng.choice(["Die", "De", "gone", "", None])) for _ in range(3 * n)] + [(None, "De"), ("p0", "Die"), ("p0", "Die"), ("p1", "De")]
    return {"names": ("path string, name string", names), "links": ("source string, target string", links)}


@pytest.mark.parametrize("operator", [graph.citing_notes, graph.rename_impact])
def test_notes_are_not_paired_with_all_links_to_their_name(spark, operator):
    ours, theirs = rows_of_both(spark, operator, **page_rows(40))
    assert ours == theirs
    # one name, n notes and n links to it: n rows, not n * n, leave every join
    spark.range(3000).selectExpr("concat('p', id) AS path", "'Die' AS name").createOrReplaceTempView("same_names")
    made = operator(names=spark.table("same_names"), links=spark.table("same_names").selectExpr("path AS source", "name AS target"))
    assert made.count() == 3000
    widest = max(joined_rows(made), default=0)
    assert widest <= 3000


def joined_rows(made):
    """Rows that each join of a finished plan gave."""
    made.collect()
    return [node.metrics().apply("numOutputRows").value() for node in nodes(made) if "Join" in node.nodeName()]


def nodes(made):
    """The operators of a finished plan."""
    out, todo = [], [made._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        out.append(node)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_blocks_of_fragments_give_the_best_notes(spark, monkeypatch):
    """Many small blocks, ties of scores and paths, and a note in several blocks: the same as all pairs."""
    monkeypatch.setattr(packing, "NOTE_BLOCK", 7)
    monkeypatch.setattr(packing, "QUERY_BLOCK", 3)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    held = [(f"n/é{k % 40}.md" if k % 3 else f"n/{k % 40}.md", k // 40, [(w, rng.choice([0.5, 1.0, 2.0, 1e-9])) for w in rng.sample(words, rng.randint(1, 5))]) for k in range(200)]
    asked = [(q, rng.sample(words, rng.randint(1, 3))) for q in range(10)] + [(90, []), (91, ["absent"])]
    vectors = spark.createDataFrame(held, "path string, rank int, entries array<struct<term: string, weight: double>>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, terms array<string>")
    for limit in (1, 4, 1000):
        got = {}
        for r in bm25.best_notes(packing.ranked(vectors, queries, limit), limit).orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append((r.path, r["rank"], r.score))
        want = {}
        for q, terms in asked:
            best = {}
            for path, rank, entries in held:
                if hit := [w for t, w in entries if t in terms]:
                    best[path] = min(best.get(path, (0, 99)), (-round(sum(hit), 6), rank))
            if best:
                want[q] = [(p, rank, -score) for p, (score, rank) in sorted(best.items(), key=lambda b: (b[1][0], b[0]))[:limit]]
        assert got == want


def test_bounds_of_a_part_leave_the_result_whole(spark, monkeypatch):
    """Searches with a first bound, and tasks that keep the best of many small blocks, find the same notes."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    notes = spark.createDataFrame([(f"n{k}.md", " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 900])))) for k in range(150)], "path string, content string")
    queries = spark.createDataFrame([(q, " ".join(rng.sample(words, 3))) for q in range(8)] + [(90, "absent"), (91, "the")], "query_id int, query string")
    held = spark.createDataFrame([(f"n{k % 60}.md", k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(200)], "path string, row_idx bigint, embedding array<double>")
    asked = held.where("row_idx % 20 = 0").select(F.col("row_idx").alias("query_id"), "embedding")
    counts = bm25.term_counts(fragments.fragments(notes))
    searches = [lambda: bm25.search(counts, queries, 5), lambda: fresh.search(notes, queries, 5), lambda: vectors.search(held, asked, 5, "mix")]
    want = [sorted(map(tuple, found().collect())) for found in searches]
    for name, value in {"NOTE_BLOCK": 5, "QUERY_BLOCK": 3, "FIRST": 3, "FIRST_ROWS": 0, "MEETINGS": 7}.items():
        monkeypatch.setattr(packing, name, value)
    assert [sorted(map(tuple, found().collect())) for found in searches] == want and len(want[0]) == 40


def test_a_note_that_comes_again_counts_once():
    floors = packing.Floors(2)
    one = np.zeros(1, np.int64)
    for path, score in (("a", 3.0), ("a", 2.5), ("a", 3.5)):
        floors.add(0, 2, one, floors.notes([path]), np.array([score]))
        assert floors.least(0, 2).tolist() == [-np.inf, -np.inf]
    floors.add(0, 2, one, floors.notes(["b"]), np.array([1.0]))
    assert floors.least(0, 2).tolist() == [1.0, -np.inf]


def test_no_row_for_a_fragment_and_a_query(spark):
    """Every query matches every note: what leaves a task is a few rows a query, not all of them."""
    notes = spark.range(600).selectExpr("concat('n', id, '.md') AS path", "concat('alpha beta gamma word', id) AS content")
    queries = spark.range(40).selectExpr("id AS query_id", "'alpha beta gamma' AS query")
    for found in (fresh.search(notes, queries, 2), bm25.search(bm25.term_counts(fragments.fragments(notes)), queries, 2)):
        assert found.count() == 80
        assert max(rows_shuffled(found)) < 600 * 40 / 4


def rows_shuffled(made):
    made.collect()
    return [node.metrics().apply("shuffleRecordsWritten").value() for node in nodes(made) if node.nodeName() == "Exchange"]


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    spark.range(20000).selectExpr("concat('n', id, '.md') AS path", "0 AS rank", "'' AS title", "sha2(string(id), 256) AS text").write.parquet(str(tmp_path / "f"))
    held = spark.read.parquet(str(tmp_path / "f"))
    assert scratch.slices(held) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(scratch, "SLICE_BYTES", 50_000)
    n = scratch.slices(held)
    assert n > 10 and bm25.term_counts(held).rdd.getNumPartitions() == n


def test_sums_of_terms_are_those_of_their_postings(spark):
    notes = spark.createDataFrame([("a.md", "red red blue"), ("b.md", "blue green 7"), ("c.md", "red")], "path string, content string")
    counts = bm25.term_counts(fragments.fragments(notes))
    want = {}
    for r in bm25.postings(counts).collect():
        df, tf, weight = want.get(r.term, (0, 0, 0.0))
        want[r.term] = (df + 1, tf + r.tf, weight + r.weight)
    got = {r.term: (r.df, r.tf, r.weight) for r in bm25.term_weights(counts).collect()}
    assert got.keys() == want.keys() and all(got[t][:2] == want[t][:2] and abs(got[t][2] - want[t][2]) < 1e-9 for t in want)


def test_recordings_are_parsed_once(spark):
    text = "# T\n\n## 👤 User\n\nhello\n\n## 🤖 Assistant\n\nok <details><summary>🔧 run</summary>\n**Erreur** :\n```\nbad\n```\n</details>\n"
    raws = spark.createDataFrame([(f"r{k}", text) for k in range(3)] + [("none", None), ("plain", "no blocks")], "raw_id string, text string")
    made = recordings.rendered(raws)
    assert made.count() == 5
    # the rest reads what was written: no recording is split into blocks or calls again
    assert not [n for n in (made.collect(), nodes(made))[1] if n.nodeName() == "Generate"]
