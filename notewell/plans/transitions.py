"""Registered queries of queue transitions and job administration, with SQL by windows and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.operators import transitions
from notewell.plans.dialect import SqlOperator
from notewell.plans.registry import DERIVED, input_frame, input_sql, query

DERIVED["analysis_rows"] = SqlOperator(("orders",), lambda d: """SELECT o_orderkey AS event_id, CAST(o_custkey AS STRING) AS source_path, CAST(o_orderkey AS STRING) AS source_hash, CASE WHEN o_orderpriority = '5-LOW' THEN 'v0' ELSE 'v1' END AS version,
  CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 19 = 0 THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'blocked' END AS status, CAST(NULL AS STRING) AS analysis_path, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS blocked_reason FROM @orders""")
DERIVED["analysis_requests"] = SqlOperator(("customer", "orders"), lambda d: """SELECT c_custkey AS request_id, CAST(c_custkey - CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END AS STRING) AS source_path, CASE c_mktsegment WHEN 'BUILDING' THEN 'done' WHEN 'MACHINERY' THEN 'done' WHEN 'AUTOMOBILE' THEN 'requeue' ELSE 'block' END AS action,
  CASE WHEN c_acctbal < 2000 THEN '' WHEN c_acctbal < 4000 THEN 'other' ELSE o.newest END AS source_hash, concat(' ', c_mktsegment) AS reason, c_name AS actor, concat('analysis/', CAST(c_custkey AS STRING)) AS analysis_path
  FROM @customer c LEFT JOIN (SELECT o_custkey, CAST(max(o_orderkey) AS STRING) AS newest FROM @orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
_ROWS, _ASKED = input_sql("analysis_rows"), input_sql("analysis_requests")
_DECIDED = f"""WITH q AS MATERIALIZED ({_ROWS}), a AS MATERIALIZED ({_ASKED}), d AS MATERIALIZED (SELECT a.*, CASE
    WHEN EXISTS (SELECT 1 FROM a b WHERE b.source_path = a.source_path AND b.request_id < a.request_id) THEN 'later'
    WHEN action = 'done' THEN CASE WHEN coalesce(source_hash, '') = '' THEN 'no hash' ELSE coalesce((SELECT CASE WHEN status = 'done' THEN 'unchanged' ELSE 'done' END FROM q WHERE q.source_path = a.source_path AND q.source_hash = a.source_hash AND version = 'v1'), 'inserted') END
    ELSE coalesce((SELECT CASE WHEN coalesce(a.source_hash, '') NOT IN ('', arg_max(q.source_hash, event_id)) THEN 'stale hash' WHEN a.action = 'block' THEN 'blocked' ELSE 'requeued' END FROM q WHERE q.source_path = a.source_path AND version = 'v1' AND status = CASE a.action WHEN 'block' THEN 'pending' ELSE 'blocked' END HAVING count(*) > 0),
      CASE action WHEN 'block' THEN 'nothing pending' ELSE 'nothing blocked' END) END AS outcome FROM a),
  t AS MATERIALIZED (SELECT d.*, CASE outcome WHEN 'blocked' THEN (SELECT max(event_id) FROM q WHERE q.source_path = d.source_path AND version = 'v1' AND status = 'pending') WHEN 'requeued' THEN (SELECT max(event_id) FROM q WHERE q.source_path = d.source_path AND version = 'v1' AND status = 'blocked')
    WHEN 'done' THEN CAST(source_hash AS BIGINT) END AS target FROM d)"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queue = input_frame(spark, sf_dir, "analysis_rows")
    return queue, transitions.decisions(queue, input_frame(spark, sf_dir, "analysis_requests"), "v1")


@query(f"{_DECIDED} SELECT request_id, source_path, outcome, target FROM t")
def queue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[1].select("request_id", "source_path", "outcome", "target")


@query(f"""{_DECIDED} SELECT event_id, q.source_path, q.source_hash, CASE WHEN event_id = target THEN CASE outcome WHEN 'requeued' THEN 'pending' ELSE outcome END
    WHEN outcome IN ('done', 'inserted', 'unchanged') AND version = 'v1' AND q.source_hash <> t.source_hash AND status IN ('pending', 'missing') THEN 'superseded' WHEN outcome = 'blocked' AND version = 'v1' AND event_id <> target AND status IN ('pending', 'missing') THEN 'superseded' ELSE status END AS status,
    CASE WHEN event_id = target AND outcome = 'done' THEN t.analysis_path END AS analysis_path, CASE WHEN event_id = target AND outcome = 'blocked' THEN trim(reason) ELSE blocked_reason END AS blocked_reason
  FROM q LEFT JOIN (SELECT * FROM t WHERE outcome IN ('done', 'inserted', 'unchanged', 'blocked', 'requeued')) t ON t.source_path = q.source_path
  UNION ALL SELECT (SELECT max(event_id) FROM q) + request_id - (SELECT min(request_id) FROM a) + 1, source_path, source_hash, 'done', analysis_path, NULL FROM t WHERE outcome = 'inserted'""")
def queue_after_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, decided = _decided(spark, sf_dir)
    return transitions.queue_after(queue, decided, "v1").drop("version")


@query(f"{_DECIDED} SELECT request_id, t.source_path, q.source_hash, outcome AS action, CASE outcome WHEN 'blocked' THEN trim(t.reason) ELSE coalesce(q.blocked_reason, '') END AS reason, actor FROM t JOIN q ON q.event_id = target WHERE outcome IN ('blocked', 'requeued')")
def queue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.audit_rows(*_decided(spark, sf_dir))


# ---------------------------------------------------------------- administration
DERIVED["admin_jobs"] = SqlOperator(("lineitem",), lambda d: f"""SELECT substr({d.sha256("concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))")}, 1, 16) AS job_id, l_orderkey * 10 + l_linenumber AS row_no, CAST(l_partkey AS STRING) AS source, CAST(l_suppkey % 7 AS STRING) AS source_hash,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 1 THEN 'alternate_quarantined' ELSE 'quarantined' END WHEN l_returnflag = 'A' THEN 'leased' ELSE 'merged' END AS status, CAST(floor(l_tax * 100) AS BIGINT) % 4 AS attempts,
  CAST(floor(l_discount * 100) AS BIGINT) % 4 AS attempts_alternate, CASE WHEN l_quantity > 40 THEN 'Invalid: too long' ELSE 'stale' END AS last_error FROM @lineitem""")
_JOBS = input_sql("admin_jobs")


@query(f"""WITH j AS MATERIALIZED ({_JOBS}), chosen AS (SELECT * FROM j WHERE status IN ('quarantined', 'alternate_quarantined') AND contains(lower(last_error), 'invalid') ORDER BY row_no, job_id LIMIT 500)
  SELECT c.job_id, c.status AS from_status, CASE WHEN n.newest > c.row_no THEN c.status ELSE 'alternate_pending' END AS status, CASE WHEN n.newest > c.row_no THEN 'source has changed' END AS skip, c.attempts, CASE WHEN n.newest > c.row_no THEN c.attempts_alternate ELSE 0 END AS attempts_alternate, CASE WHEN n.newest > c.row_no THEN c.last_error ELSE 'requeue: mended' END AS last_error
  FROM chosen c LEFT JOIN LATERAL (SELECT max(row_no) AS newest FROM j WHERE j.source = c.source AND j.source_hash <> c.source_hash) n ON true""")
def admin_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest quarantined jobs of one kind of error, queued again on the alternate route."""
    jobs = input_frame(spark, sf_dir, "admin_jobs")
    plan = transitions.admin_plan(jobs, "requeue-alternate", reason_like="INVALID", limit=500)
    after, _ = transitions.admin_applied(jobs, plan, "requeue-alternate", "mended")
    return plan.select("job_id", F.col("status").alias("from_status"), "skip").join(after.select("job_id", "status", "attempts", "attempts_alternate", "last_error"), "job_id")
