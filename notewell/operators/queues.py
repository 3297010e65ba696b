"""State transitions of the analysis queue and the job queue, as functions of whole tables.

Each takes the state (and what was observed) and gives rows or the next state; committing it is
the caller's. Frequent keys only ever meet in joins and aggregates with a partial step.
"""

from __future__ import annotations

from notewell.plans.dialect import Dialect, SqlOperator

NOW = "TIMESTAMP '1996-01-01 00:00:00'"
MAX_ATTEMPTS = 3
#: Jobs and bytes that one claim takes at most: one prefix of the queue, oldest first, and always one job.
CLAIM_LIMIT = 10
CLAIM_BYTES = 20_000

_NEWEST = "SELECT source_path, version, max(event_id) AS newest FROM @queue WHERE status <> 'superseded' GROUP BY source_path, version"


def _list_pending(d: Dialect) -> str:
    return f"""SELECT p.event_id, p.source_path, p.source_agent, p.source_hash, p.size_bytes FROM @queue p
      JOIN ({_NEWEST}) n ON n.source_path = p.source_path AND n.version = p.version WHERE p.status = 'pending' AND p.event_id >= n.newest"""


def _supersede(d: Dialect) -> str:
    return f"""SELECT p.event_id, CASE WHEN p.status = 'pending' AND n.newest > p.event_id THEN 'superseded' ELSE p.status END AS status
      FROM @queue p LEFT JOIN ({_NEWEST}) n ON n.source_path = p.source_path AND n.version = p.version"""


def _queue_status(d: Dialect) -> str:
    return f"""SELECT source_agent, count(*) AS n, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'done' THEN 1 END) AS done, count(CASE WHEN status = 'blocked' THEN 1 END) AS blocked,
      count(CASE WHEN status = 'missing' THEN 1 END) AS missing, min(CASE WHEN status = 'pending' THEN event_id END) AS oldest_pending, {d.last("event_id", "CASE WHEN status = 'done' THEN event_id END")} AS last_done
      FROM @queue GROUP BY source_agent"""


def _pending_count(d: Dialect) -> str:
    return "SELECT count(DISTINCT source_path) AS n FROM @queue WHERE status = 'pending'"


def _latest(d: Dialect) -> str:
    return f"SELECT source_path, max(event_id) AS event_id, {d.last('status', 'event_id')} AS status, {d.last('source_hash', 'event_id')} AS source_hash FROM @queue GROUP BY source_path"


def _reconcile(d: Dialect) -> str:
    return """SELECT q.event_id, CASE WHEN q.status = 'pending' AND m.source_path IS NULL THEN 'missing' WHEN q.status = 'missing' AND m.source_hash = q.source_hash THEN 'pending' ELSE q.status END AS status,
      CASE WHEN q.status = 'pending' AND m.source_path IS NULL THEN 'missing' WHEN q.status = 'missing' AND m.source_hash = q.source_hash THEN 'reappeared' END AS event
      FROM @queue q LEFT JOIN @mirror m ON m.source_path = q.source_path"""


def _lost(d: Dialect) -> str:
    return f"""SELECT q.event_id, q.source_path FROM @queue q WHERE q.status = 'done' AND q.updated_at < {NOW} - INTERVAL '24' HOUR
      AND NOT EXISTS (SELECT 1 FROM @mirror m WHERE m.source_path = q.source_path)"""


def _scan(d: Dialect) -> str:
    return """SELECT coalesce(q.source_path, m.source_path) AS source_path, coalesce(q.source_hash, m.source_hash) AS source_hash, q.event_id,
      CASE WHEN q.event_id IS NULL THEN 'pending' WHEN m.source_path IS NOT NULL AND q.status = 'superseded' THEN 'pending' WHEN m.source_path IS NOT NULL THEN q.status
           WHEN o.source_path IS NOT NULL AND q.status IN ('pending', 'missing') THEN 'superseded' ELSE q.status END AS status,
      CASE WHEN q.event_id IS NULL THEN 'new' WHEN m.source_path IS NOT NULL AND q.status = 'superseded' THEN 'revived' WHEN m.source_path IS NOT NULL THEN 'unchanged'
           WHEN o.source_path IS NOT NULL AND q.status IN ('pending', 'missing') THEN 'replaced' ELSE 'kept' END AS outcome
      FROM @queue q FULL OUTER JOIN @mirror m ON m.source_path = q.source_path AND m.source_hash = q.source_hash
      LEFT JOIN @mirror o ON o.source_path = q.source_path"""


def _block(d: Dialect) -> str:
    return f"""SELECT r.source_path, p.event_id, CASE WHEN p.event_id IS NULL THEN 'nothing pending' WHEN r.expected_hash <> p.source_hash THEN 'stale hash' ELSE 'blocked' END AS outcome
      FROM @requests r LEFT JOIN (SELECT source_path, max(event_id) AS event_id, {d.last('source_hash', 'event_id')} AS source_hash FROM @queue WHERE status = 'pending' GROUP BY source_path) p ON p.source_path = r.source_path"""


def _reap(d: Dialect) -> str:
    return f"""SELECT job_id, CASE WHEN status = 'leased' AND expires_at < {NOW} THEN 'pending' ELSE status END AS status, status = 'leased' AND expires_at < {NOW} AS reaped FROM @jobs"""


def _newest_of_other_hash() -> str:
    """Per source and hash, the newest row of any other hash."""
    return """SELECT source, source_hash, CASE WHEN row_number() OVER w = 1 THEN lead(newest) OVER w ELSE first_value(newest) OVER w END AS other
      FROM (SELECT source, source_hash, max(row_no) AS newest FROM @jobs GROUP BY source, source_hash) a WINDOW w AS (PARTITION BY source ORDER BY newest DESC)"""


def _claim(d: Dialect) -> str:
    # the oldest jobs up to the limit are few rows, whatever the queue holds, so one running sum takes them
    return f"""SELECT job_id, document, chunk_bytes, running FROM (
      SELECT job_id, document, chunk_bytes, sum(chunk_bytes) OVER w AS running, row_number() OVER w AS n FROM (
        SELECT j.job_id, j.document, j.chunk_bytes, j.row_no FROM @jobs j LEFT JOIN ({_newest_of_other_hash()}) o ON o.source = j.source AND o.source_hash = j.source_hash
        WHERE j.status = 'pending' AND j.attempts < {MAX_ATTEMPTS} AND (o.other IS NULL OR o.other < j.row_no) ORDER BY j.row_no LIMIT {CLAIM_LIMIT}) t
      WINDOW w AS (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c WHERE n = 1 OR running <= {CLAIM_BYTES}"""


def _jobs_status(d: Dialect) -> str:
    states = ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in ("pending", "leased", "submitted", "merged"))
    return f"""SELECT source_hash, count(*) AS n, {states}, count(DISTINCT document) AS documents, sum(CASE WHEN attempts >= {MAX_ATTEMPTS} THEN 1 ELSE 0 END) AS exhausted,
      count(CASE WHEN status = 'leased' AND expires_at < {NOW} THEN 1 END) AS expired, max(CASE WHEN status = 'merged' THEN updated_at END) AS last_merge FROM @jobs GROUP BY source_hash"""


def _merge_ready(d: Dialect) -> str:
    return """SELECT document, count(CASE WHEN status IN ('submitted', 'merged') THEN 1 END) AS submitted, max(chunk_count) AS chunk_count FROM @jobs GROUP BY document
      HAVING max(chunk_count) > 0 AND count(CASE WHEN status IN ('submitted', 'merged') THEN 1 END) >= max(chunk_count)"""


def _submit(d: Dialect) -> str:
    return f"""SELECT j.job_id, CASE WHEN o.other > j.row_no AND j.status IN ('leased', 'pending') THEN 'stale' WHEN j.status IN ('submitted', 'merged') THEN 'duplicate'
      WHEN j.status <> 'leased' THEN 'not leased' WHEN j.expires_at < {NOW} THEN 'lease expired' WHEN j.attempts >= {MAX_ATTEMPTS} THEN 'quarantined' ELSE 'accepted' END AS outcome
      FROM @jobs j LEFT JOIN ({_newest_of_other_hash()}) o ON o.source = j.source AND o.source_hash = j.source_hash"""


def _release(d: Dialect) -> str:
    return f"""SELECT job_id, CASE WHEN status <> 'leased' THEN status WHEN attempts + 1 >= {MAX_ATTEMPTS} THEN 'quarantined' ELSE 'pending' END AS status, CASE WHEN status = 'leased' THEN attempts + 1 ELSE attempts END AS attempts,
      least(21600, 300 * CAST(power(2, attempts) AS BIGINT)) AS backoff_s FROM @jobs"""


def _sync(d: Dialect) -> str:
    return """SELECT j.job_id, CASE WHEN s.source_hash IS NOT NULL AND s.source_hash <> j.source_hash AND j.status IN ('pending', 'leased') THEN 'superseded' ELSE j.status END AS status
      FROM @jobs j LEFT JOIN @sources s ON s.source = j.source"""


list_pending = SqlOperator(("queue",), _list_pending)
supersede = SqlOperator(("queue",), _supersede)
queue_status = SqlOperator(("queue",), _queue_status)
pending_count = SqlOperator(("queue",), _pending_count)
latest = SqlOperator(("queue",), _latest)
reconcile_missing = SqlOperator(("queue", "mirror"), _reconcile)
lost_analyses = SqlOperator(("queue", "mirror"), _lost)
scan = SqlOperator(("queue", "mirror"), _scan)
block_outcome = SqlOperator(("queue", "requests"), _block)
reap = SqlOperator(("jobs",), _reap)
claim = SqlOperator(("jobs",), _claim)
jobs_status = SqlOperator(("jobs",), _jobs_status)
merge_ready = SqlOperator(("jobs",), _merge_ready)
submit_outcome = SqlOperator(("jobs",), _submit)
release_outcome = SqlOperator(("jobs",), _release)
sync_sources = SqlOperator(("jobs", "sources"), _sync)
