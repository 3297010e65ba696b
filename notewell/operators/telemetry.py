"""Call telemetry: runs of a session, outcomes, references, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.operators.transcripts import redacted
from notewell.plans.dialect import Dialect, SqlOperator

#: Seconds without a call after which a session's next call begins a new run.
GAP_S = 900


def _runs(d: Dialect) -> str:
    start, end = d.micros("started_at"), f"{d.micros('started_at')} + duration_ms * 1000"
    return f"""SELECT session, run, count(*) AS calls, min(began) AS began, {d.last('ended', 'place')} AS last_at, max(duration_ms) AS max_ms, sum(bytes_out) AS bytes_out,
      count(CASE WHEN outcome NOT IN ('ok', 'duplicate') THEN 1 END) AS errors, count(CASE WHEN outcome = 'duplicate' THEN 1 END) AS duplicates,
      count(CASE WHEN tool = 'view' AND outcome IN ('ok', 'duplicate') THEN 1 END) AS views, {d.last('tool', 'place')} AS last_tool,
      max(CASE WHEN outcome = 'client_disconnect' THEN 1 ELSE 0 END) = 1 AS disconnected
      FROM (SELECT *, sum(CASE WHEN before IS NULL OR began - before > {GAP_S * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY began, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
        FROM (SELECT id, session, tool, outcome, duration_ms, bytes_out, {start} AS began, {end} AS ended, lag({end}) OVER (PARTITION BY session ORDER BY {start}, id) AS before, row_number() OVER (PARTITION BY session ORDER BY {start}, id) AS place FROM @calls) c) r
      GROUP BY session, run"""


def _outcomes(d: Dialect) -> str:
    return """SELECT id, CASE WHEN outcome = 'client_disconnect' THEN 'client_disconnect' WHEN http_status >= 400 THEN 'http_error' WHEN bytes_out <= 6000 AND outcome = 'tool_error' THEN 'tool_error'
      WHEN bytes_out <= 6000 AND outcome = 'duplicate' THEN 'duplicate' ELSE 'ok' END AS outcome FROM @calls"""


def _refs(d: Dialect) -> str:
    hashed = d.sha256("concat('notes/', session, '.md')")
    return f"SELECT id, CASE WHEN id % 3 = 0 THEN concat('job:', substr({d.sha256('CAST(id AS STRING)')}, 1, 12)) ELSE concat('p:', substr({hashed}, 1, 10)) END AS ref FROM @calls"


def _requests(d: Dialect) -> str:
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)" if d.spark else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    return f"SELECT id, tool, {k} AS k FROM @calls"


def _health(d: Dialect) -> str:
    now = d.micros("TIMESTAMP '2024-02-01 00:00:00'")
    return f"""SELECT tool, count(*) AS calls, count(CASE WHEN outcome NOT IN ('ok', 'duplicate') THEN 1 END) AS errors, ({now} - max({d.micros('started_at')})) AS age_us,
      {now} - max({d.micros('started_at')}) < 48 * 3600 * CAST(1000000 AS BIGINT) AS fresh FROM @calls GROUP BY tool"""


def _audit_tail(d: Dialect) -> str:
    return "SELECT session, id, tool, outcome, n FROM (SELECT session, id, tool, outcome, row_number() OVER (PARTITION BY session ORDER BY id DESC) AS n FROM @calls) c WHERE n <= 5"


#: Hours of one slice of a session's calls: what one task orders at a time.
SLICE_H = 6


def run_metrics(calls: DataFrame, now: Column, tools: dict[str, str], gap_s: int = GAP_S) -> DataFrame:
    """(key, run, …) of every run: a session's calls, or a client's without a session, with no gap over ``gap_s``.

    calls: id, started_at, duration_ms, session, client, rpc_method, tool, outcome, bytes_out. ``tools`` names the counts
    ``reads``, ``writes``, ``claims``, ``submits`` and ``releases`` by tool; writes are told apart by outcome. A run
    ends by the last disconnection or clean close in it, else it has stopped silently if its end is over the gap
    ago, and is open if not. Gaps count from the end of the call that began before.

    A key's calls are ordered within slices of ``SLICE_H`` hours; only a slice's ends are compared with its
    neighbours', so a client that makes a third of all calls isn't one task's work.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.coalesce(blank("session"), F.concat(F.lit("nosession:"), F.coalesce(blank("client"), F.lit("?"))))
    began = F.unix_micros(F.col("started_at").cast("timestamp"))
    held = calls.withColumns({"key": key, "began": began}).withColumn("ended", F.col("began") + F.coalesce("duration_ms", F.lit(0)) * 1000).where("began is not null")
    held = held.withColumn("slice", F.floor(F.col("began") / (SLICE_H * 3_600_000_000)))
    gap = gap_s * 1_000_000
    inside = Window.partitionBy("key", "slice").orderBy("began", "id")
    cut = held.withColumn("breaks", F.coalesce((F.col("began") - F.lag("ended").over(inside) > gap).cast("int"), F.lit(0)))
    cut = cut.withColumn("within", F.sum("breaks").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("began", "id")
    slices = cut.groupBy("key", "slice").agg(F.min("began").alias("first"), F.max_by("ended", place).alias("last"), F.sum("breaks").alias("all_breaks"))
    along = Window.partitionBy("key").orderBy("slice")
    new = F.coalesce((F.col("first") - F.lag("last").over(along) > gap).cast("int"), F.lit(1))
    numbered = slices.withColumn("starts", new)
    before = F.coalesce(F.sum("all_breaks").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.select("key", "slice", (F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)) + before).alias("base"))
    placed = cut.join(numbered, ["key", "slice"]).withColumn("run", F.col("base") + F.col("within"))
    fine = F.col("outcome").isin("ok", "duplicate")
    count = lambda when: F.count(F.when(when, 1))
    of = lambda name: F.col("tool") == tools[name]
    end = F.when(F.col("outcome") == "client_disconnect", "client_disconnect").when(F.col("rpc_method") == "session/close", "clean_close")
    named = blank("tool").isNotNull()
    made = placed.groupBy("key", "run").agg(
        F.min("began").alias("began"), F.max_by("ended", place).alias("last_at"), F.count("*").alias("calls"), F.max("duration_ms").alias("max_ms"), F.sum(F.coalesce("bytes_out", F.lit(0))).alias("bytes_out"),
        count(~fine).alias("errors"), count(of("reads") & fine).alias("reads"), *[count(of("writes") & (F.col("outcome") == o)).alias(f"writes_{n}") for n, o in (("ok", "ok"), ("dup", "duplicate"), ("err", "tool_error"))],
        *[count(of(n) & fine).alias(n) for n in ("claims", "submits", "releases")],
        F.max_by(F.when(named, F.concat("tool", F.lit(":"), "outcome")), F.when(named, place)).alias("last_tool"), F.max_by(end, F.when(end.isNotNull(), place)).alias("said"),
    )
    ended = F.coalesce("said", F.when(F.unix_micros(now) - F.col("last_at") > gap, "silent_stop").otherwise("open"))
    return made.withColumns({"end": ended, "duration_s": F.round((F.col("last_at") - F.col("began")) / 1e6, 1)}).drop("said")


runs = SqlOperator(("calls",), _runs)
outcomes = SqlOperator(("calls",), _outcomes)
refs = SqlOperator(("calls",), _refs)
requests = SqlOperator(("calls",), _requests)
health = SqlOperator(("calls",), _health)
audit_tail = SqlOperator(("calls",), _audit_tail)


# Marks of a refusal, of a repeated write and of its message at the beginning of a response.
REFUSAL = r"""\\?"etat\\?"\s*:\s*\\?"refuse\\?"|\\?"isError\\?"\s*:\s*true"""
DUPLICATE = r"""\\?"duplicate\\?"\s*:\s*true"""
MESSAGE = r"""\\?"message\\?"\s*:\s*\\?"((?:[^"\\]|\\.){0,200})"""
NO_MESSAGE = "refus"

#: Bytes of a request that is parsed whole, of a response that may be a refusal, and of its part that is looked at.
MAX_BODY, SMALL_RESPONSE, HEAD = 2_000_000, 6_000, 8_192


def refusal_message(head: Column) -> Column:
    """The short message of a refused call, without secrets; null where the response is none."""
    head = F.substring(head, 1, HEAD)
    raw = F.when(head.rlike(MESSAGE), F.regexp_extract(head, MESSAGE, 1)).otherwise(NO_MESSAGE)
    plain = F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"'))
    return F.when(head.rlike(REFUSAL), F.substring(redacted(plain), 1, 160))


def call_outcomes(calls: DataFrame, write_tools: tuple[str, ...]) -> DataFrame:
    """``calls`` (tool, http_status, bytes_out, disconnected, finished, exception, head, …) with ``outcome`` and ``message``.

    An exception comes first, unless the client left an unfinished response; then the client, the
    status, a refusal and a repeated write. Only short responses are read: longer ones may quote such marks.
    """
    left = F.col("disconnected") & ~F.col("finished")
    small = F.col("bytes_out") <= SMALL_RESPONSE
    told = F.when(small & (F.coalesce("tool", F.lit("")) != ""), refusal_message(F.col("head")))
    repeated = small & F.col("tool").isin(*write_tools) & F.substring("head", 1, HEAD).rlike(DUPLICATE)
    outcome = (
        F.when(left, "client_disconnect")
        .when(F.col("exception").isNotNull(), "exception")
        .when(F.col("http_status") >= 400, "http_error")
        .when(F.col("_told").isNotNull(), "tool_error")
        .when(repeated, "duplicate")
        .otherwise("ok")
    )
    held = calls.withColumn("_told", told).withColumn("outcome", outcome)
    message = F.when(F.col("outcome") == "exception", F.col("exception")).when(F.col("outcome") == "tool_error", F.col("_told"))
    return held.withColumn("message", message).drop("_told")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parsed_requests(bodies: DataFrame) -> DataFrame:
    """``bodies`` (body, …) with ``method``, ``tool`` and ``ref``; of a batch, its first call.

    ``ref`` is the job's first 12 characters or ten hex digits of the path's SHA-256. A body that isn't
    an object of JSON has method ``?``; of a body over 2 MB only the beginning is read, and it has no ref.
    """
    parsed = F.when(F.octet_length("body") <= MAX_BODY, F.try_parse_json(F.col("body")))
    held = bodies.withColumn("_all", parsed)
    held = held.withColumn("_doc", F.when(_kind(F.col("_all")).startswith("ARRAY"), F.try_variant_get("_all", "$[0]", "variant")).otherwise(F.col("_all")))
    arguments = {k: F.try_variant_get("_doc", f"$.params.arguments.{k}", "variant") for k in ("job_id", "path", "source_path")}
    texts = {k: F.when(_kind(v) == "STRING", F.nullif(F.try_variant_get("_doc", f"$.params.arguments.{k}", "string"), F.lit(""))) for k, v in arguments.items()}
    named = F.nullif(F.try_variant_get("_doc", "$.method", "string"), F.lit(""))
    whole = F.coalesce(named, F.when(F.try_variant_get("_doc", "$.result", "variant").isNotNull(), F.lit("response")), F.lit(""))
    begin = F.substring("body", 1, HEAD)
    head_method = F.coalesce(F.nullif(F.regexp_extract(begin, r'"method"\s*:\s*"([^"]{1,60})"', 1), F.lit("")), F.lit("?"))
    empty_batch = _kind(F.col("_all")).startswith("ARRAY") & F.col("_doc").isNull()
    method = (
        F.when(F.coalesce("body", F.lit("")) == "", "")
        .when(F.octet_length("body") > MAX_BODY, head_method)
        .when(empty_batch, "")
        .when(F.coalesce(_kind(F.col("_doc")).startswith("OBJECT"), F.lit(False)), F.substring(whole, 1, 60))
        .otherwise("?")
    )
    held = held.withColumn("method", method)
    name = F.when(F.octet_length("body") > MAX_BODY, F.regexp_extract(begin, r'"name"\s*:\s*"([A-Za-z0-9_]{1,60})"', 1)).otherwise(F.substring(F.try_variant_get("_doc", "$.params.name", "string"), 1, 60))
    place = F.coalesce(texts["path"], texts["source_path"])
    ref = F.when(texts["job_id"].isNotNull(), F.concat(F.lit("job:"), F.substring(texts["job_id"], 1, 12))).otherwise(F.concat(F.lit("p:"), F.substring(F.sha2(place.cast("binary"), 256), 1, 10)))
    called = F.col("method") == "tools/call"
    held = held.withColumn("tool", F.when(called, F.coalesce(name, F.lit(""))).otherwise("")).withColumn("ref", F.when(called, F.coalesce(ref, F.lit(""))).otherwise(""))
    return held.drop("_all", "_doc")


def spool_stats(files: DataFrame, now: Column) -> DataFrame:
    """One row about a spool's ``files`` (place, modified_at): how many wait, failed or are done, and their ages in seconds."""
    age = F.unix_micros(now) / 1e6 - F.unix_micros("modified_at") / 1e6
    waiting, failed = F.col("place") == "queue", F.col("place") == "failed"
    return files.agg(
        F.count_if(waiting).alias("waiting"), F.round(F.max(F.when(waiting, age)), 1).alias("oldest_s"),
        F.count_if(failed).alias("failed"), F.count_if(failed & (age < 3600)).alias("failed_last_hour"), F.round(F.min(F.when(failed, age)), 1).alias("last_failure_s"),
        F.count_if(F.col("place") == "done").alias("done"),
    )


def freshness(files: DataFrame, now: Column, limit_s: int = 48 * 3600) -> DataFrame:
    """One row about ``files`` (modified_at): how many there are, the age of the newest and whether it is fresh; no files aren't."""
    age = F.unix_micros(now) / 1e6 - F.unix_micros(F.max("modified_at")) / 1e6
    return files.agg(F.count("*").alias("n"), age.alias("age_s")).withColumn("fresh", F.coalesce(F.col("age_s") < limit_s, F.lit(False)))
