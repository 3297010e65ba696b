"""Queue transitions and administration of jobs on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from notewell.operators import transitions

REQUESTS = "request_id bigint, source_path string, action string, source_hash string, reason string, actor string, analysis_path string"
JOBS = "job_id string, row_no bigint, source string, source_hash string, status string, attempts bigint, attempts_alternate bigint, last_error string"


def after(spark, rows, *requests):
    queue = spark.createDataFrame([(*r, None, None) if len(r) == 5 else r for r in rows], transitions.QUEUE)
    decided = transitions.decisions(queue, spark.createDataFrame([(k + 1, *r, f" why {k} ", "me", f"an/{k}") for k, r in enumerate(requests)], REQUESTS), "v")
    outcomes = [r.outcome for r in sorted(decided.collect(), key=lambda r: r.request_id)]
    states = {(r.source_path, r.source_hash): (r.status, r.analysis_path, r.blocked_reason) for r in transitions.queue_after(queue, decided, "v").collect()}
    return outcomes, states, sorted((r.source_path, r.source_hash, r.action, r.reason) for r in transitions.audit_rows(queue, decided).collect())


def test_done_blocked_and_requeued_rows(spark):
    rows = [
        (1, "a", "1", "v", "pending"), (2, "a", "2", "v", "pending"), (3, "a", "0", "w", "pending"), (4, "b", "1", "v", "missing"), (5, "b", "2", "v", "pending"), (6, "c", "1", "v", "blocked", None, "bad"),
        (7, "d", "1", "v", "done"), (8, "d", "2", "v", "pending"), (9, "e", "1", "v", "pending"), (10, "f", "1", "v", "pending"),
    ]
    outcomes, states, audit = after(spark, rows, ("a", "done", "2"), ("b", "block", ""), ("c", "requeue", "1"), ("d", "done", "1"), ("e", "block", "old"), ("f", "done", "9"), ("f", "block", ""), ("g", "requeue", None), ("a2", "block", None), ("h", "done", ""), ("i", "dance", "x"))
    assert outcomes == ["done", "blocked", "requeued", "unchanged", "stale hash", "inserted", "later", "nothing blocked", "nothing pending", "no hash", "unknown action"]
    assert states == {
        ("a", "1"): ("superseded", None, None), ("a", "2"): ("done", "an/0", None), ("a", "0"): ("pending", None, None), ("b", "1"): ("superseded", None, None), ("b", "2"): ("blocked", None, "why 1"),
        ("c", "1"): ("pending", None, "bad"), ("d", "1"): ("done", None, None), ("d", "2"): ("superseded", None, None), ("e", "1"): ("pending", None, None), ("f", "1"): ("superseded", None, None), ("f", "9"): ("done", "an/5", None),
    }
    assert audit == [("b", "2", "blocked", "why 1"), ("c", "1", "requeued", "bad")]


def test_empty_queues_and_requests(spark):
    queue, none = spark.createDataFrame([(1, "a", "1", "v", "pending", None, None)], transitions.QUEUE), spark.createDataFrame([], REQUESTS)
    decided = transitions.decisions(queue, none, "v")
    assert decided.count() == 0 and transitions.queue_after(queue, decided, "v").count() == 1
    made = transitions.decisions(queue.limit(0), spark.createDataFrame([(5, "x", "done", "h", None, None, "p")], REQUESTS), "v")
    assert [(r.event_id, r.status) for r in transitions.queue_after(queue.limit(0), made, "v").collect()] == [(1, "done")]


def jobs(spark):
    rows = [
        ("aaaaaaaa01", 1, "s", "1", "quarantined", 3, 1, "Invalid title"), ("aaaaaaaa02", 2, "t", "1", "alternate_quarantined", 2, 3, "invalid"), ("bbbbbbbb01", 3, "u", "1", "quarantined", 3, 0, None),
        ("bbbbbbbb02", 4, "s", "2", "merged", 0, 0, None), ("cccccccc01", 5, "w", "1", "pending", 1, 2, "x"), ("cccccccc02", 6, "x", "1", "deferred", 2, 0, None), ("cccccccc03", 7, "y", "1", "leased", 0, 0, None),
    ]
    return spark.createDataFrame(rows, JOBS)


def test_admin_actions_need_a_filter_and_a_cause(spark):
    held = jobs(spark)
    for action, given in (("requeue-pending", {}), ("terminal-skip", {"reason_like": "x"})):
        with pytest.raises(ValueError, match="needed"):
            transitions.admin_plan(held, action, **given)
    with pytest.raises(ValueError, match="cause"):
        transitions.admin_applied(held, transitions.admin_plan(held, "offload-alternate"), "offload-alternate", " ")


def test_admin_actions_move_what_they_may(spark):
    held = jobs(spark)
    prefixes = lambda *p: spark.createDataFrame([(x,) for x in p], "p string")
    plan = lambda *a, **k: {r.job_id: (r.to, r.skip) for r in transitions.admin_plan(held, *a, **k).collect()}
    assert plan("requeue-pending", reason_like="INVALID") == {"aaaaaaaa01": ("pending", "source has changed"), "aaaaaaaa02": ("pending", None)}
    assert plan("requeue-alternate", prefixes("aaaaaaaa", "bbbb", "zzzzzzzz", "bbbbbbbb01")) == {"aaaaaaaa01": ("alternate_pending", "source has changed"), "aaaaaaaa02": ("alternate_pending", None), "bbbbbbbb01": ("alternate_pending", None)}
    assert plan("terminal-skip", prefixes("bbbbbbbb"), "none") == {} and plan("terminal-skip", prefixes("bbbbbbbb")) == {"bbbbbbbb01": ("terminal_skip", None)}
    assert plan("offload-alternate") == {"cccccccc01": ("alternate_pending", None), "cccccccc02": ("alternate_pending", None)} and len(plan("offload-alternate", limit=1)) == 1
    moved, audit = transitions.admin_applied(held, transitions.admin_plan(held, "requeue-pending", reason_like="invalid"), "requeue-pending", " mended ")
    rows = {r.job_id: (r.status, r.attempts, r.attempts_alternate, r.last_error) for r in moved.collect()}
    assert rows["aaaaaaaa02"] == ("pending", 0, 3, "requeue: mended") and rows["aaaaaaaa01"] == ("quarantined", 3, 1, "Invalid title") and len(rows) == 7
    assert [tuple(r) for r in audit.collect()] == [("aaaaaaaa02", "requeue-pending", "alternate_quarantined", "pending", 2, "invalid", "mended")]
    again = transitions.admin_plan(moved, "requeue-pending", reason_like="invalid").where("skip is null")
    assert again.count() == 0 and moved.where(F.col("status") == "quarantined").count() == 2
