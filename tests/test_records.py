"""Run metrics with hot clients, the vector cache, retention by day and models' answers."""

import datetime
import json
import random

from pyspark.sql import functions as F

from notewell.operators import extraction, graph, telemetry
from notewell.sources.cache import DAY_S, DayTable, VectorCache
from notewell.sources.generations import Generations

CALLS = "id bigint, t double, duration_ms bigint, session string, client string, rpc_method string, tool string, outcome string, bytes_out bigint"
TOOLS = {"reads": "read", "writes": "write", "claims": "claim", "submits": "submit", "releases": "release"}


def plain_runs(rows, now):
    done, open_ = [], {}
    for i, t, ms, session, client, method, tool, outcome, size in sorted(rows, key=lambda r: (r[1], r[0])):
        key = session or f"nosession:{client or '?'}"
        run = open_.get(key)
        if run is None or t - run["last"] > 900:
            run = open_[key] = {"key": key, "start": t, "calls": 0, "reads": 0, "ok": 0, "errors": 0, "end": None, "bytes": 0, "tool": None}
            done.append(run)
        run["calls"] += 1
        run["last"] = t + (ms or 0) / 1000
        run["bytes"] += size or 0
        run["errors"] += outcome not in ("ok", "duplicate")
        run["reads"] += tool == "read" and outcome in ("ok", "duplicate")
        run["ok"] += tool == "write" and outcome == "ok"
        run["tool"] = f"{tool}:{outcome}" if tool else run["tool"]
        run["end"] = "client_disconnect" if outcome == "client_disconnect" else "clean_close" if method == "session/close" else run["end"]
    return sorted((r["key"], r["start"], r["calls"], r["reads"], r["ok"], r["errors"], r["bytes"], r["tool"], r["end"] or ("silent_stop" if now - r["last"] > 900 else "open")) for r in done)


def test_runs_of_a_hot_client_across_slices(spark):
    rng = random.Random(14)
    rows, t = [], 0.0
    for k in range(900):
        t += rng.choice([0.0, 1.0, 200.0, 900.0, 901.0, 30_000.0])
        session = rng.choice([None, None, "", "s1", "s2"])
        rows.append((k, t, rng.choice([None, 0, 1000, 500_000]), session, rng.choice([None, "", "c"]) if not session else "c", rng.choice(["x", "session/close"]), rng.choice(["", "read", "write"]), rng.choice(["ok", "ok", "duplicate", "tool_error", "client_disconnect"]), rng.choice([None, 5])))
    calls = spark.createDataFrame(rows, CALLS).withColumn("started_at", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    got = telemetry.run_metrics(calls, F.timestamp_seconds(F.lit(t + 100)), TOOLS).collect()
    assert sorted((r.key, r.began / 1e6, r.calls, r.reads, r.writes_ok, r.errors, r.bytes_out, r.last_tool, r.end) for r in got) == plain_runs(rows, t + 100)
    assert telemetry.run_metrics(calls.limit(0), F.current_timestamp(), TOOLS).count() == 0


def test_a_cache_has_hits_misses_touches_and_purges(spark, tmp_path):
    cache = VectorCache(Generations(spark, str(tmp_path)), "m")
    asked = []

    def embed(missing):
        asked.append(sorted(r.text for r in missing.collect()))
        return missing.select("path", F.array(F.length("text").cast("double")).alias("vector"))

    use = lambda now, *texts: {r.path: (r.hit, list(r.vector)) for r in cache.vectors(spark.createDataFrame([(t,) for t in texts], "text string"), embed, now).collect()}
    first = use(0, "a", "bb", "bb", None, "")
    assert asked[-1] == ["", "a", "bb"] and sorted(v[0] for _, v in first.values()) == [0.0, 1.0, 2.0] and not any(h for h, _ in first.values())
    second = use(20 * DAY_S, "bb", "ccc")
    assert asked[-1] == ["ccc"] and sorted(h for h, _ in second.values()) == [False, True]
    seen = {r.path: r.seen_at for r in cache.rows().collect()}
    assert len(seen) == 4 and sorted(seen.values()) == [0, 0, 20 * DAY_S, 20 * DAY_S]
    assert cache.purge(30 * DAY_S) == 0 and cache.purge(30 * DAY_S + 1) == 2 and cache.purge(30 * DAY_S + 1) == 0
    assert sorted(len(r.vector) and r.vector[0] for r in cache.rows().collect()) == [2.0, 3.0]
    use(40 * DAY_S, "a")
    assert asked[-1] == ["a"] and cache.rows().count() == 3


def test_other_models_have_other_keys(spark):
    row = spark.createDataFrame([("x",)], "text string")
    from notewell.sources.cache import content_key

    assert row.select(content_key(F.col("text"), "m")).first() != row.select(content_key(F.col("text"), "n")).first()


def test_retention_drops_what_is_older_and_nothing_younger(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "calls"), "at")
    hours = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=7 * k)) for k in range(40)]
    frame = spark.createDataFrame([(k, t.isoformat(sep=" ")) for k, t in hours] + [(99, None)], "id int, t string").withColumn("at", F.col("t").cast("timestamp"))
    table.append(frame.where("id % 2 = 0 OR at is null"))
    table.append(frame.where("id % 2 = 1"))
    now = datetime.datetime(2024, 1, 12, 5)
    for _ in range(2):
        table.purge(now, days=5)
        assert sorted(r.id for r in table.read().collect()) == [k for k, t in hours if t >= now - datetime.timedelta(days=5)]
    assert table.days()[0] == "2024-01-07"
    assert DayTable(spark, str(tmp_path / "none"), "at").purge(now) == []


def test_answers_lose_their_wrapping_alone(spark):
    answers = [
        ('﻿  {"b": 1, "a": 2}\n', None, {"b": 1, "a": 2}), ('```json\n{"extraction": {"x": [1]}}\n```', None, {"x": [1]}), ('```\n{"extraction": 5}\n```', None, {"extraction": 5}),
        ('{"extraction": {"x": 1}, "y": 2}', None, {"extraction": {"x": 1}, "y": 2}), ("```json\n\n```", "empty", None), (None, "empty", None), (" ﻿ ", "empty", None),
        ("[1]", "not an object", None), ("5", "not an object", None), ("null", "not an object", None), ('Sure: {"a": 1}', "not JSON", None), ('```json\n{"a": 1}\n``` done', "not JSON", None),
    ]
    got = sorted(extraction.parsed_answers(spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(answers)], "k int, answer string")).collect(), key=lambda r: r.k)
    for r, (_, problem, body) in zip(got, answers, strict=True):
        assert (r.problem, r.body) == (problem, None if body is None else json.dumps(body, sort_keys=True, separators=(",", ":")))


def test_names_of_many_notes_are_told_apart_without_pairs(spark):
    names = [(f"n{k}.md", "index") for k in range(300)] + [("a.md", "x"), ("b.md", "x"), ("b.md", "x"), ("c.md", "alone"), (None, "x"), ("d.md", None), ("e.md", None)]
    got = {(r.slug, r.path): (r.n_others, r.first_other) for r in graph.slug_collisions(spark.createDataFrame(names, "path string, name string")).collect()}
    assert got["index", "n0.md"] == (299, "n1.md") and got["index", "n7.md"] == (299, "n0.md") and got["x", "a.md"] == (1, "b.md") and got["x", "b.md"] == (1, "a.md") and len(got) == 302
