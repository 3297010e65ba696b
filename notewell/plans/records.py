"""Registered queries of run metrics, the vector cache, retention and models' answers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.operators import compaction, extraction, telemetry
from notewell.plans.dialect import SqlOperator
from notewell.plans.registry import DERIVED, input_frame, input_sql, query
from notewell.sources.cache import DayTable, VectorCache
from notewell.sources.generations import Generations
from notewell.sources.scratch import Scratch

# ---------------------------------------------------------------- runs of calls
_NOW = "TIMESTAMP '2024-01-30 20:00:00'"
_TOOLS = {"reads": "view", "writes": "click", "claims": "signup", "submits": "purchase", "releases": "error"}
DERIVED["client_calls"] = SqlOperator(("events",), lambda d: f"""SELECT event_id AS id, ts AS started_at, CAST(floor(value * 20000) AS BIGINT) AS duration_ms, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS session,
  CASE WHEN user_id % 6 = 0 THEN NULL ELSE concat('client-', CAST(user_id % 4 AS STRING)) END AS client, CASE WHEN event_id % 17 = 0 THEN 'session/close' ELSE 'tools/call' END AS rpc_method, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS tool,
  CASE WHEN value > 60 THEN 'client_disconnect' WHEN value > 40 THEN 'tool_error' WHEN value > 30 THEN 'duplicate' ELSE 'ok' END AS outcome, CASE WHEN value < 50 THEN CAST({d.extracted("props", "([0-9]+)", 1)} AS BIGINT) END AS bytes_out FROM @events""")


@query(f"""WITH c AS (SELECT *, CASE WHEN coalesce(session, '') <> '' THEN session ELSE 'nosession:' || coalesce(client, '?') END AS key, epoch_us(started_at) AS began, epoch_us(started_at) + duration_ms * 1000 AS ended FROM ({input_sql("client_calls")}) x),
  b AS (SELECT *, CASE WHEN began - lag(ended) OVER w <= 900000000 THEN 0 ELSE 1 END AS starts FROM c WINDOW w AS (PARTITION BY key ORDER BY began, id)),
  r AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY began, id) AS run, CASE WHEN outcome = 'client_disconnect' THEN 'client_disconnect' WHEN rpc_method = 'session/close' THEN 'clean_close' END AS said FROM b)
  SELECT key, CAST(run AS BIGINT) AS run, min(began) AS began, arg_max(ended, (began, id)) AS last_at, count(*) AS calls, max(duration_ms) AS max_ms, CAST(sum(coalesce(bytes_out, 0)) AS BIGINT) AS bytes_out, count(*) FILTER (outcome NOT IN ('ok', 'duplicate')) AS errors,
    count(*) FILTER (tool = 'view' AND outcome IN ('ok', 'duplicate')) AS reads, count(*) FILTER (tool = 'click' AND outcome = 'ok') AS writes_ok, count(*) FILTER (tool = 'click' AND outcome = 'duplicate') AS writes_dup, count(*) FILTER (tool = 'click' AND outcome = 'tool_error') AS writes_err,
    count(*) FILTER (tool = 'signup' AND outcome IN ('ok', 'duplicate')) AS claims, count(*) FILTER (tool = 'purchase' AND outcome IN ('ok', 'duplicate')) AS submits, count(*) FILTER (tool = 'error' AND outcome IN ('ok', 'duplicate')) AS releases,
    arg_max(tool || ':' || outcome, (began, id)) FILTER (tool <> '') AS last_tool, coalesce(arg_max(said, (began, id)) FILTER (said IS NOT NULL), CASE WHEN epoch_us({_NOW}) - arg_max(ended, (began, id)) > 900000000 THEN 'silent_stop' ELSE 'open' END) AS "end",
    round((arg_max(ended, (began, id)) - min(began)) / 1e6, 1) AS duration_s FROM r GROUP BY key, run""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_metrics(input_frame(spark, sf_dir, "client_calls"), F.expr(_NOW), _TOOLS)


# ---------------------------------------------------------------- cache and retention
_AGAIN = "text || CASE WHEN lang = 'en' THEN ' again' ELSE '' END"


@query(f"""WITH keys AS (SELECT sha256('m' || chr(0) || text) AS key, true AS early, false AS late FROM documents WHERE text IS NOT NULL UNION ALL SELECT sha256('m' || chr(0) || ({_AGAIN})), false, true FROM documents WHERE text IS NOT NULL),
  told AS (SELECT key, bool_or(early) AS early, bool_or(late) AS late FROM keys GROUP BY key)
  SELECT key, CASE WHEN late THEN 1728000 ELSE 0 END AS seen_at, CASE WHEN late AND early THEN 'hit' WHEN late THEN 'made' ELSE 'unseen' END AS second_use, late AS kept FROM told""")
def cache_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector cache after all documents, after all again 20 days later, of which English ones have changed, and after a purge."""
    docs = input_frame(spark, sf_dir, "documents")
    cache = VectorCache(Generations(spark, Scratch(spark).path("cache")), "m")
    embed = lambda missing: missing.select("path", F.array(F.length("text").cast("float")).alias("vector"))
    cache.vectors(docs.select("text"), embed, 0)
    second = cache.vectors(docs.select(F.concat("text", F.when(F.col("lang") == "en", " again").otherwise("")).alias("text")), embed, 20 * 86_400)
    held = cache.rows()
    cache.purge(40 * 86_400)
    kept = cache.rows().select("path", F.lit(True).alias("kept"))
    told = second.select("path", F.when(F.col("hit"), "hit").otherwise("made").alias("second_use"))
    return held.join(told, "path", "left").join(kept, "path", "left").select(F.col("path").alias("key"), "seen_at", F.coalesce("second_use", F.lit("unseen")).alias("second_use"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1""")
def retained_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by day after a purge, appended in two parts."""
    events = input_frame(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = DayTable(spark, Scratch(spark).path("calls"), "ts")
    days.append(events.where("event_type <> 'view'"))
    days.append(events.where("event_type = 'view'"))
    days.purge(datetime.datetime(2024, 1, 30, 12), days=20)
    return days.read().groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# ---------------------------------------------------------------- answers of models
DERIVED["answers"] = SqlOperator(("events",), lambda d: """SELECT event_id, CASE event_type WHEN 'view' THEN concat(chr(10), props, '  ') WHEN 'click' THEN concat('```json', chr(10), '{"z": 1, "extraction": ', props, ', "a": ', CAST(user_id AS STRING), '}', chr(10), '```') WHEN 'signup' THEN concat('```', chr(10), '{"extraction": {"user": ', CAST(user_id AS STRING), ', "k": ', props, '}}', chr(10), '```')
  WHEN 'purchase' THEN concat('[', props, ']') ELSE CASE WHEN user_id % 2 = 0 THEN concat('Here it is: ', props) ELSE concat('```', chr(10), chr(10), '```') END END AS answer FROM @events""")
_K = "regexp_extract(props, '([0-9]+)', 1)"


@query(f"""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'not an object' WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'not JSON' ELSE 'empty' END END AS problem,
  sha256(CASE event_type WHEN 'view' THEN '{{"k":' || {_K} || '}}' WHEN 'click' THEN '{{"a":' || user_id || ',"extraction":{{"k":' || {_K} || '}},"z":1}}' WHEN 'signup' THEN '{{"k":{{"k":' || {_K} || '}},"user":' || user_id || '}}' END) AS digest FROM events""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.parsed_answers(input_frame(spark, sf_dir, "answers")).select("event_id", "problem", "digest")


# ---------------------------------------------------------------- conversations within a budget
_BUDGET, _FIRST, _USER = 3_000, 700, 120
_MARK = "chr(10) || '[… message cut …]'"


def _shortened(limit: str) -> str:
    return f"CASE WHEN length(text) <= {limit} THEN text ELSE rtrim(substr(text, 1, {limit}), ' ') || {_MARK} END"


@query(f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
  p AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER c AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC ROWS UNBOUNDED PRECEDING) AS after, sum(length(text) + 16) OVER c AS taken FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text), c AS (PARTITION BY conv_id)),
  j AS (SELECT *, CASE WHEN taken <= {_BUDGET} THEN 'whole' WHEN place < 2 THEN 'first' WHEN after <= {int((_BUDGET - 600) * 0.45)} OR place = n - 1 THEN 'tail' WHEN role = 'user' THEN 'middle' END AS part FROM p),
  s AS (SELECT conv_id, turn, place, n, role, part, CASE part WHEN 'first' THEN {_shortened(str(_FIRST))} WHEN 'middle' THEN {_shortened(str(_USER))} WHEN 'tail' THEN CASE WHEN after > {int((_BUDGET - 600) * 0.45)} THEN {_shortened(str(max(500, int((_BUDGET - 600) * 0.45))))} ELSE text END ELSE text END AS text FROM j WHERE part IS NOT NULL),
  u AS (SELECT *, {_BUDGET - 600} - sum(CASE WHEN part IN ('first', 'tail') THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS mid_room, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, place) - 1 AS nth, count(*) OVER (PARTITION BY conv_id, part) AS of_part FROM s),
  k AS (SELECT conv_id, turn, place, n, role, part, text FROM u WHERE part <> 'middle' OR (mid_room > {_USER + 40} AND nth % greatest(1, CAST(ceil(of_part * {_USER + 40} / mid_room) AS BIGINT)) = 0)),
  t AS (SELECT *, sum(length(text) + 16) OVER (PARTITION BY conv_id) AS total, part <> 'whole' AND place > 1 AND place < n - 1 AS victim FROM k),
  v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, victim ORDER BY turn, place) - 1 - count(*) OVER (PARTITION BY conv_id, victim) // 2 AS off, count(*) OVER (PARTITION BY conv_id, victim) AS victims FROM t),
  g AS (SELECT *, sum(length(text) + 16) OVER (PARTITION BY conv_id, victim ORDER BY abs(off), CASE WHEN victims % 2 = 1 THEN -off ELSE off END ROWS UNBOUNDED PRECEDING) - length(text) - 16 AS freed FROM v),
  f AS (SELECT *, sum(length(text) + 16) OVER (PARTITION BY conv_id ORDER BY turn, place ROWS UNBOUNDED PRECEDING) - length(text) AS begin_ FROM g WHERE NOT (victim AND total > {_BUDGET - 600} AND freed < total - {_BUDGET - 600}))
  SELECT conv_id, turn, place, n, part, sha256(CASE WHEN part = 'whole' THEN text ELSE substr(text, 1, CAST(greatest(0, {_BUDGET} - begin_) AS BIGINT)) END) AS text_sha256 FROM f""")
def compacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations within 3,000 characters."""
    kept = compaction.compacted(input_frame(spark, sf_dir, "conversations"), _BUDGET, _FIRST, _USER)
    return kept.select("conv_id", "turn", "place", "n", "part", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
