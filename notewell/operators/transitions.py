"""Transitions of the analysis queue and administration of jobs, as functions of whole tables.

A batch of requests becomes decisions, one for each path at most; decisions become the next rows of the
queue and rows of the audit. Everything meets by equality of paths or ids, and what is known of a
path is a few extrema, combined before the shuffle; no path's history is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUEUE = "event_id bigint, source_path string, source_hash string, version string, status string, analysis_path string, blocked_reason string"
MAX_REASON = 500


def decisions(queue: DataFrame, requests: DataFrame, version: str) -> DataFrame:
    """A row for each request with its outcome, the row it is about (``target``) and the hash it keeps (``keep``).

    requests: request_id, source_path, action (done, block, requeue), source_hash (the version that was analysed, or that a
    block or a new try is meant for; empty: the newest), reason, actor, analysis_path. Of several requests for
    one path the first is taken, the others must be sent again (``later``).

    done: the version's row is done, or made if it isn't there; block: the newest pending row, unless the
    hash is another; requeue: the newest blocked row, alike.
    """
    own = queue.where(F.col("version") == version)
    newest = lambda status: F.max_by(F.struct("event_id", "source_hash"), F.when(F.col("status") == status, F.col("event_id")))
    known = own.groupBy(F.col("source_path").alias("of")).agg(newest("pending").alias("pending"), newest("blocked").alias("blocked"), F.max(F.when(F.col("status") == "pending", True)).alias("has_pending"), F.max(F.when(F.col("status") == "blocked", True)).alias("has_blocked"))
    exact = own.groupBy(F.col("source_path").alias("at_path"), F.col("source_hash").alias("at_hash")).agg(F.max_by(F.struct("event_id", "status"), "event_id").alias("row"))
    first = requests.groupBy(F.col("source_path").alias("first_path")).agg(F.min("request_id").alias("first_id"))
    met = requests.join(first, F.col("source_path") == F.col("first_path")).join(known, F.col("source_path") == F.col("of"), "left")
    met = met.join(exact, (F.col("source_path") == F.col("at_path")) & (F.col("source_hash") == F.col("at_hash")), "left")
    wanted = F.coalesce("source_hash", F.lit(""))

    def parked(kind: str, nothing: str, done: str) -> F.Column:
        return F.when(F.col(f"has_{kind}").isNull(), nothing).when((wanted != "") & (wanted != F.col(f"{kind}.source_hash")), "stale hash").otherwise(done)

    outcome = (
        F.when(F.col("request_id") > F.col("first_id"), "later")
        .when(F.col("action") == "done", F.when(wanted == "", "no hash").when(F.col("row").isNull(), "inserted").when(F.col("row.status") == "done", "unchanged").otherwise("done"))
        .when(F.col("action") == "block", parked("pending", "nothing pending", "blocked"))
        .when(F.col("action") == "requeue", parked("blocked", "nothing blocked", "requeued"))
        .otherwise("unknown action")
    )
    told = met.withColumn("outcome", outcome)
    target = F.when(F.col("outcome") == "blocked", F.col("pending.event_id")).when(F.col("outcome") == "requeued", F.col("blocked.event_id")).when(F.col("outcome") == "done", F.col("row.event_id"))
    keep = F.when(F.col("outcome") == "blocked", F.col("pending.source_hash")).when(F.col("outcome") == "requeued", F.col("blocked.source_hash")).when(F.col("outcome").isin("done", "inserted", "unchanged"), wanted)
    return told.select(*requests.columns, "outcome", target.alias("target"), keep.alias("keep"))


def queue_after(queue: DataFrame, decided: DataFrame, version: str) -> DataFrame:
    """The queue's rows (``QUEUE``) after the decisions; versions that a done or blocked one outdates are superseded."""
    columns = [c.split()[0] for c in QUEUE.split(", ")]
    acts = decided.where("keep is not null").select(F.col("source_path").alias("of"), "outcome", "target", "keep", "reason", F.col("analysis_path").alias("made_path"))
    joined = queue.select(*columns).join(acts, F.col("source_path") == F.col("of"), "left")
    here = F.col("event_id") == F.col("target")
    outdated = F.col("outcome").isin("done", "inserted", "unchanged", "blocked") & (F.col("version") == version) & (F.col("source_hash") != F.col("keep")) & F.col("status").isin("pending", "missing")
    status = F.when(here, F.when(F.col("outcome") == "requeued", "pending").otherwise(F.col("outcome"))).when(outdated, "superseded").otherwise(F.col("status"))
    path = F.when(here & (F.col("outcome") == "done"), F.col("made_path")).otherwise(F.col("analysis_path"))
    reason = F.when(here & (F.col("outcome") == "blocked"), F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, MAX_REASON)).otherwise(F.col("blocked_reason"))
    kept = joined.select("event_id", "source_path", "source_hash", "version", status.alias("status"), path.alias("analysis_path"), reason.alias("blocked_reason"))
    base = queue.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("base")).crossJoin(decided.agg(F.min("request_id").alias("least")))  # one row
    new = decided.where("outcome = 'inserted'").crossJoin(F.broadcast(base))
    made = new.select((F.col("base") + F.col("request_id") - F.col("least") + 1).alias("event_id"), "source_path", F.col("keep").alias("source_hash"), F.lit(version).alias("version"), F.lit("done").alias("status"), "analysis_path", F.lit(None).cast("string").alias("blocked_reason"))
    return kept.unionByName(made)


def audit_rows(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """(request_id, source_path, source_hash, action, reason, actor) of what was blocked or queued again, with the reason it was blocked for."""
    was = queue.select(F.col("event_id").alias("target_id"), "blocked_reason")
    acted = decided.where("outcome IN ('blocked', 'requeued')").join(was, F.col("target") == F.col("target_id"), "left")
    reason = F.when(F.col("outcome") == "blocked", F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, MAX_REASON)).otherwise(F.coalesce("blocked_reason", F.lit("")))
    return acted.select("request_id", "source_path", F.col("keep").alias("source_hash"), F.col("outcome").alias("action"), reason.alias("reason"), F.substring(F.coalesce("actor", F.lit("")), 1, 120).alias("actor"))


# ------------------------------------------------------------------ administration of jobs
#: Where each action leads, and the states it may start from.
ADMIN = {
    "requeue-pending": ("pending", ("quarantined", "alternate_quarantined")), "requeue-alternate": ("alternate_pending", ("quarantined", "alternate_quarantined")),
    "terminal-skip": ("terminal_skip", ("quarantined", "alternate_quarantined")), "offload-alternate": ("alternate_pending", ("pending", "deferred")),
}
MOST = {"requeue-pending": 500, "requeue-alternate": 500, "terminal-skip": 500, "offload-alternate": 2_000}
PREFIX = 8


def admin_plan(jobs: DataFrame, action: str, prefixes: DataFrame | None = None, reason_like: str | None = None, limit: int = 50) -> DataFrame:
    """(job_id, status, to, skip) of the oldest jobs that an administrator's action would move: a dry run.

    jobs: job_id, row_no (creation order), source, source_hash, status, attempts, attempts_alternate, last_error. prefixes: one
    column of job ids or their beginnings (8 hexadecimal digits at least; shorter or other ones select nothing).
    A job is never selected without a filter, but by an offload; one whose source has a newer version
    isn't queued again (``skip``). ``limit`` is bounded by ``MOST``.
    """
    to, states = ADMIN[action]
    if action != "offload-alternate" and prefixes is None and not reason_like:
        raise ValueError("a filter is needed: job ids or a reason")
    if action == "terminal-skip" and prefixes is None:
        raise ValueError("job ids are needed")
    chosen = jobs.where(F.col("status").isin(*states))
    if prefixes is not None:
        name = prefixes.columns[0]
        given = prefixes.select(F.trim(name).alias("prefix")).where(F.col("prefix").rlike(f"^[0-9a-f]{{{PREFIX},}}$")).distinct()
        matched = chosen.join(given, (F.substring("job_id", 1, PREFIX) == F.substring("prefix", 1, PREFIX)) & F.startswith("job_id", "prefix"), "left_semi")
        chosen = matched
    if reason_like:
        chosen = chosen.where(F.contains(F.lower(F.coalesce("last_error", F.lit(""))), F.lit(reason_like.lower())))
    oldest = chosen.orderBy("row_no", "job_id").limit(max(1, min(limit, MOST[action])))
    versions = jobs.groupBy(F.col("source").alias("of"), F.col("source_hash").alias("of_hash")).agg(F.max("row_no").alias("newest"))
    sources = oldest.select("source").distinct()
    others = versions.join(sources, F.col("of") == F.col("source"), "left_semi")
    newer = oldest.join(others, (F.col("source") == F.col("of")) & (F.col("source_hash") != F.col("of_hash")) & (F.col("newest") > F.col("row_no")), "left_semi").select(F.col("job_id").alias("outdated"))
    skip = F.when(F.col("outdated").isNotNull(), "source has changed") if action.startswith("requeue") else F.lit(None).cast("string")
    return oldest.join(newer, F.col("job_id") == F.col("outdated"), "left").select("job_id", "status", F.lit(to).alias("to"), skip.alias("skip"), "attempts", "attempts_alternate", "last_error")


def admin_applied(jobs: DataFrame, plan: DataFrame, action: str, cause: str) -> tuple[DataFrame, DataFrame]:
    """The jobs after an action, and its audit (job_id, event, from_status, to_status, attempts_before, last_error, detail).

    A cause is needed. What the action forgets (attempts, the last error) is in the audit.
    """
    if not cause.strip():
        raise ValueError("a cause is needed")
    moved = plan.where("skip is null")
    audit = moved.select("job_id", F.lit(action).alias("event"), F.col("status").alias("from_status"), F.col("to").alias("to_status"), F.col("attempts").alias("attempts_before"), "last_error", F.lit(cause.strip()).alias("detail"))
    acts = moved.select(F.col("job_id").alias("of"), F.col("status").alias("from_status"), "to")
    joined = jobs.join(acts, (F.col("job_id") == F.col("of")) & (F.col("status") == F.col("from_status")), "left")
    here = F.col("to").isNotNull()
    verb = {"terminal-skip": "terminal_skip", "offload-alternate": "offload"}.get(action, "requeue")
    new = {
        "status": F.when(here, F.col("to")).otherwise(F.col("status")), "last_error": F.when(here, F.substring(F.lit(f"{verb}: {cause.strip()}"), 1, 300)).otherwise(F.col("last_error")),
        "attempts": F.when(here & F.lit(action == "requeue-pending"), 0).otherwise(F.col("attempts")), "attempts_alternate": F.when(here & F.lit(ADMIN[action][0] == "alternate_pending"), 0).otherwise(F.col("attempts_alternate")),
    }
    return joined.select(*[new[c].cast(jobs.schema[c].dataType).alias(c) if c in new else c for c in jobs.columns]), audit
