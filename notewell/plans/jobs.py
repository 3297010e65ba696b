"""Registered queries of job leases, over requests that the table of events stands for.

Each event is a request for the job of its user; times run sixty times slower than the events'.
The SQL takes the requests of every job one by one in a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewell.plans.dialect import SqlOperator
from notewell.plans.registry import DERIVED, input_frame, input_sql, query
from notewell.streaming import leases

_ACTIONS = """CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'claim_alternate' ELSE 'claim' END WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'read' ELSE 'renew' END
      WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'defer' WHEN 2 THEN 'release_alternate' ELSE 'claim' END WHEN 'purchase' THEN 'submit'
      ELSE CASE event_id % 3 WHEN 0 THEN 'alternate' WHEN 1 THEN 'fail_alternate' ELSE 'claim' END END"""


def _requests(d) -> str:
    seconds = f"({d.micros('ts')} {'div' if d.spark else '//'} 60000000)"
    return f"""SELECT job_id, seq, asked_at, action, fencing, ok, payload, seconds,
      CASE WHEN action IN ('claim', 'claim_alternate') THEN CAST(seq AS STRING) ELSE CAST(max(CASE WHEN action IN ('claim', 'claim_alternate') THEN seq END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS STRING) END AS lease
      FROM (SELECT concat('job-', CAST(user_id AS STRING), '-', CAST(event_id {'div' if d.spark else '//'} 3000 AS STRING)) AS job_id, event_id AS seq, {seconds} AS asked_at, {_ACTIONS} AS action,
        CASE WHEN event_id % 7 = 0 THEN event_id % 5 END AS fencing, event_id % 5 <> 0 AS ok, {d.extracted('props', '([0-9])[^0-9]*$', 1)} AS payload, CAST(floor(value * 40) AS BIGINT) AS seconds FROM @events) e"""


DERIVED["lease_requests"] = SqlOperator(("events",), _requests)

_REQUESTS = input_sql("lease_requests")
_LEASED = "e_status IN ('leased', 'alternate_leased')"
_HELD = "action IN ('read', 'submit', 'release', 'defer', 'alternate', 'renew', 'fail_alternate', 'release_alternate')"
_OUTCOME = f"""CASE
      WHEN action = 'claim' THEN CASE WHEN e_status = 'pending' AND attempts < 3 THEN 'claimed' ELSE 'not claimable' END
      WHEN action = 'claim_alternate' THEN CASE WHEN e_status <> 'alternate_pending' OR alternate_attempts >= 3 THEN 'not claimable' WHEN next_at > asked_at THEN 'backing off' ELSE 'claimed' END
      WHEN action = 'submit' AND e_status = 'submitted' THEN CASE WHEN payload IS NOT DISTINCT FROM kept THEN 'duplicate' ELSE 'conflict' END
      WHEN lease IS NULL OR lease IS DISTINCT FROM e_lease THEN CASE WHEN lease = e_was THEN 'lease expired' ELSE 'lease invalid' END
      WHEN NOT ({_LEASED}) OR (action IN ('release', 'defer', 'alternate', 'renew') AND e_status = 'alternate_leased') OR (action IN ('fail_alternate', 'release_alternate') AND e_status = 'leased') THEN 'not leased'
      WHEN action = 'submit' THEN CASE WHEN fencing <> token THEN 'fencing mismatch' WHEN ok THEN 'submitted' ELSE 'invalid' END
      WHEN action = 'renew' THEN CASE WHEN renews >= 3 THEN 'renewals used up' ELSE 'renewed' END
      WHEN action = 'release_alternate' THEN CASE WHEN NOT ok AND failures + 1 >= 5 THEN 'failing' ELSE 'given back' END
      WHEN action = 'read' THEN 'read' WHEN action = 'release' THEN 'released' WHEN action = 'defer' THEN 'deferred' WHEN action = 'alternate' THEN 'routed' ELSE 'failed' END"""
_REPLAY = f"""WITH RECURSIVE asked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM ({_REQUESTS}) r
  ), turns(job_id, k, seq, asked_at, action, outcome, status, lease, was, kept, token, expires, renews, attempts, alternate_attempts, failures, next_at) AS (
    SELECT DISTINCT job_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '', '', 'pending', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, 0, 0, 0, CAST(NULL AS BIGINT) FROM asked
    UNION ALL
    SELECT job_id, k, seq, asked_at, action, outcome,
      CASE WHEN outcome = 'claimed' THEN CASE WHEN action = 'claim' THEN 'leased' ELSE 'alternate_leased' END WHEN outcome = 'submitted' THEN 'submitted' WHEN outcome = 'released' THEN 'pending' WHEN outcome = 'given back' THEN 'alternate_pending' WHEN outcome = 'failing' THEN 'alternate_quarantined'
        WHEN outcome = 'routed' THEN CASE WHEN alternate_attempts >= 3 THEN 'alternate_quarantined' ELSE 'alternate_pending' END
        WHEN outcome = 'deferred' OR (outcome = 'invalid' AND e_status = 'leased') THEN CASE WHEN attempts + 1 >= 3 THEN 'quarantined' ELSE 'pending' END
        WHEN outcome = 'invalid' THEN CASE WHEN alternate_attempts + 1 >= 3 THEN 'alternate_quarantined' ELSE 'alternate_pending' END
        WHEN outcome = 'failed' AND alternate_attempts + 1 >= 3 THEN 'alternate_quarantined' ELSE e_status END,
      CASE WHEN outcome = 'claimed' THEN lease WHEN outcome IN ('released', 'given back', 'failing', 'routed', 'deferred', 'invalid') OR (outcome = 'failed' AND alternate_attempts + 1 >= 3) THEN NULL ELSE e_lease END,
      CASE WHEN outcome = 'claimed' THEN NULL ELSE e_was END, CASE WHEN outcome = 'submitted' THEN payload ELSE kept END, token + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END,
      CASE WHEN outcome = 'claimed' THEN asked_at + greatest(60, least(seconds, CASE WHEN action = 'claim' THEN 900 ELSE 86400 END)) WHEN outcome = 'renewed' THEN asked_at + 900
        WHEN outcome IN ('submitted', 'released', 'given back', 'failing', 'routed', 'deferred', 'invalid') OR (outcome = 'failed' AND alternate_attempts + 1 >= 3) THEN NULL ELSE e_expires END,
      CASE WHEN outcome = 'claimed' THEN 0 WHEN outcome = 'renewed' THEN renews + 1 ELSE renews END,
      attempts + CASE WHEN outcome = 'deferred' OR (outcome = 'invalid' AND e_status = 'leased') THEN 1 ELSE 0 END,
      alternate_attempts + CASE WHEN outcome = 'failed' OR (outcome = 'invalid' AND e_status = 'alternate_leased') THEN 1 ELSE 0 END,
      failures + CASE WHEN outcome IN ('given back', 'failing') AND NOT ok THEN 1 ELSE 0 END,
      CASE WHEN outcome = 'routed' THEN NULL WHEN outcome = 'given back' THEN CASE WHEN seconds > 0 THEN asked_at + seconds END ELSE next_at END
    FROM (SELECT *, {_OUTCOME} AS outcome FROM (
      SELECT a.*, t.kept, t.token, t.renews, t.attempts, t.alternate_attempts, t.failures, t.next_at, CASE WHEN gone THEN CASE t.status WHEN 'leased' THEN 'pending' ELSE 'alternate_pending' END ELSE t.status END AS e_status,
        CASE WHEN gone THEN NULL ELSE t.lease END AS e_lease, CASE WHEN gone THEN t.lease ELSE t.was END AS e_was, CASE WHEN gone THEN NULL ELSE t.expires END AS e_expires
      FROM (SELECT * FROM turns) t JOIN asked a ON a.job_id = t.job_id AND a.k = t.k + 1, LATERAL (SELECT t.status IN ('leased', 'alternate_leased') AND coalesce(t.expires < a.asked_at, false) AS gone) g))
  )"""


@query(f"{_REPLAY} SELECT job_id, seq, action, outcome, status, token AS fencing, CAST(attempts AS BIGINT) AS attempts, expires FROM turns WHERE k > 0")
def lease_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.replayed(input_frame(spark, sf_dir, "lease_requests")).select("job_id", "seq", "action", "outcome", "status", "fencing", "attempts", "expires")


@query(f"{_REPLAY} SELECT job_id, count(*) AS n, arg_max(status, seq) AS status, arg_max(token, seq) AS fencing, CAST(arg_max(attempts, seq) AS BIGINT) AS attempts, max(expires) FILTER (k = last) AS expires FROM (SELECT *, max(k) OVER (PARTITION BY job_id) AS last FROM turns WHERE k > 0) GROUP BY job_id")
def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.job_states(leases.replayed(input_frame(spark, sf_dir, "lease_requests")))
