"""The driver's tables as the engine's relations: notes, links, calls, queue rows, jobs, messages.

Each adapter is one projection in SQL that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewell.plans.dialect import DUCK, SPARK, Dialect, SqlOperator

_TIER = "CASE doc_id % 5 WHEN 0 THEN 'notes/' WHEN 1 THEN 'wiki/entities/' WHEN 2 THEN 'wiki/sources/' WHEN 3 THEN 'raw/assets/ConvIA-Analysis/' ELSE 'raw/assets/' END"


def _notes(d: Dialect) -> str:
    return f"SELECT doc_id, concat({_TIER}, source, '/', lang, '-', lpad(CAST(doc_id AS STRING), 8, '0'), '.md') AS path, text AS content FROM @documents"


def _vectors(d: Dialect) -> str:
    div = "vec_id div 5" if d.spark else "vec_id // 5"
    return f"SELECT {div} AS note, concat(CASE ({div}) % 5 WHEN 0 THEN 'notes/' WHEN 1 THEN 'wiki/entities/' WHEN 2 THEN 'wiki/sources/' WHEN 3 THEN 'raw/assets/ConvIA-Analysis/' ELSE 'raw/assets/' END, 'v', lpad(CAST({div} AS STRING), 8, '0'), '.md') AS path, CAST(vec_id % 5 AS INT) AS rank, vec_id AS row_idx, embedding FROM @embeddings"


def _links(d: Dialect) -> str:
    targets = d.all_of("html", '<a href="/([^"]*)"', 1)
    return f"SELECT page_id, concat('pages/', CAST(page_id AS STRING), '.md') AS source, target FROM {d.explode('@pages', targets, 'target')}"


def _names(d: Dialect) -> str:
    return f"SELECT concat('pages/', CAST(page_id AS STRING), '.md') AS path, {d.extracted('html', '<a href=' + chr(34) + '/([^' + chr(34) + ']*)' + chr(34), 1)} AS name FROM @pages"


def _calls(d: Dialect) -> str:
    return """SELECT event_id AS id, CAST(user_id AS STRING) AS session, ts AS started_at, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, event_type AS tool,
      CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, CAST(floor(value * 997) AS BIGINT) AS bytes_out, props,
      CASE WHEN event_id % 11 = 0 THEN 'client_disconnect' WHEN event_type = 'error' THEN 'http_error' WHEN event_id % 7 = 0 THEN 'tool_error' WHEN event_id % 13 = 0 THEN 'duplicate' ELSE 'ok' END AS outcome
      FROM @events"""


def _queue(d: Dialect) -> str:
    return """SELECT o_orderkey AS event_id, CAST(o_custkey AS STRING) AS source_path, CAST(o_orderkey % 5 AS STRING) AS source_hash, o_orderpriority AS source_agent, o_orderdate AS updated_at,
      CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, 'v1' AS version,
      CASE WHEN o_orderkey % 17 = 0 THEN 'missing' WHEN o_orderkey % 19 = 0 THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'blocked' END AS status
      FROM @orders"""


def _jobs(d: Dialect) -> str:
    return """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS job_id, l_orderkey * 10 + l_linenumber AS row_no, CAST(l_partkey AS STRING) AS source,
      CAST(l_orderkey % 3 AS STRING) AS source_hash, l_linenumber AS chunk_index, CAST(floor(l_quantity * 100) AS BIGINT) AS chunk_bytes, l_orderkey AS document,
      count(*) OVER (PARTITION BY l_orderkey) AS chunk_count, l_shipdate AS expires_at, CAST(floor(l_tax * 100) AS BIGINT) % 5 AS attempts, l_shipdate AS updated_at,
      CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'R' THEN 'submitted' WHEN l_returnflag = 'A' THEN 'leased' ELSE 'merged' END AS status
      FROM @lineitem"""


def _messages(d: Dialect) -> str:
    return "SELECT conv_id, turn, role, text FROM @conversations"


ADAPTERS = {
    "notes": SqlOperator(("documents",), _notes),
    "vectors": SqlOperator(("embeddings",), _vectors),
    "links": SqlOperator(("pages",), _links),
    "names": SqlOperator(("pages",), _names),
    "calls": SqlOperator(("events",), _calls),
    "queue": SqlOperator(("orders",), _queue),
    "jobs": SqlOperator(("lineitem",), _jobs),
    "messages": SqlOperator(("conversations",), _messages),
}


#: Tables of long texts, on which work before the first shuffle is heavy.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer partitions than there are cores (one row group is one task) are dealt out."""
    held = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return held.repartition(cores) if name in TEXTS and held.rdd.getNumPartitions() < cores else held


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapted relation, or the driver's table of that name."""
    if name not in ADAPTERS:
        return table(spark, sf_dir, name)
    operator = ADAPTERS[name]
    return operator(**{t: table(spark, sf_dir, t) for t in operator.inputs})


def relation_sql(name: str) -> str:
    """The same relation as DuckDB SQL."""
    if name not in ADAPTERS:
        return f"SELECT * FROM {name}"
    operator = ADAPTERS[name]
    sql = operator.text(DUCK)
    for t in operator.inputs:
        sql = sql.replace(f"@{t}", t)
    return sql


__all__ = ["ADAPTERS", "SPARK", "relation", "relation_sql", "table"]
