"""Index maintenance: selection, diffs, incremental batches, versions and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.plans.dialect import Dialect, SqlOperator


def _versions(d: Dialect) -> str:
    return f"SELECT path, {d.sha256('content')} AS sha256, CAST({d.bytes('content')} AS BIGINT) AS size FROM @notes"


def _page(d: Dialect) -> str:
    return "SELECT path, length(content) AS n_chars, substr(content, 101, 200) AS page FROM @notes"


def _diff(d: Dialect) -> str:
    return """SELECT coalesce(m.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'removed' WHEN m.sha256 <> i.sha256 THEN 'changed' ELSE 'same' END AS state
      FROM @mirror m FULL OUTER JOIN @index i ON i.path = m.path"""


def _check(d: Dialect) -> str:
    return """SELECT path, 'missing' AS problem FROM @mirror m WHERE NOT EXISTS (SELECT 1 FROM @index i WHERE i.path = m.path)
      UNION ALL SELECT path, 'orphan' AS problem FROM @index i WHERE NOT EXISTS (SELECT 1 FROM @mirror m WHERE m.path = i.path)"""


def _fresh_only(d: Dialect) -> str:
    return "SELECT path, sha256 FROM @mirror m WHERE NOT EXISTS (SELECT 1 FROM @index i WHERE i.path = m.path)"


def _cas(d: Dialect) -> str:
    return "SELECT m.path, CASE WHEN i.sha256 IS NULL THEN 'unchecked' WHEN i.sha256 = m.sha256 THEN 'current' ELSE 'stale' END AS state FROM @mirror m LEFT JOIN @index i ON i.path = m.path"


def _dirty(d: Dialect) -> str:
    return f"SELECT DISTINCT path, substr({d.sha256('path')}, 1, 32) AS key FROM (SELECT path FROM @queue UNION ALL SELECT path FROM @inflight UNION ALL SELECT path FROM @deferred) u"


def _tokens(d: Dialect) -> str:
    return f"SELECT path, CAST(floor({d.bytes('content')} / 2.44) AS BIGINT) + 1 AS tokens FROM @notes"


note_versions = SqlOperator(("notes",), _versions)
read_page = SqlOperator(("notes",), _page)
mirror_index_diff = SqlOperator(("mirror", "index"), _diff)
index_check = SqlOperator(("mirror", "index"), _check)
fresh_only = SqlOperator(("mirror", "index"), _fresh_only)
cas_check = SqlOperator(("mirror", "index"), _cas)
dirty_pending = SqlOperator(("queue", "inflight", "deferred"), _dirty)
token_estimate = SqlOperator(("notes",), _tokens)


def reindexed(index: DataFrame, changed: DataFrame, made: DataFrame) -> DataFrame:
    """The rows of an index after a batch: rows of changed paths go, the rows ``made`` of them come.

    changed: path, deleted. Paths that can't be read are left out of ``changed`` and keep their rows.
    """
    kept = index.join(changed.select("path").distinct(), "path", "left_anti")
    live = changed.where(~F.col("deleted")).select("path").distinct()
    return kept.unionByName(made.join(live, "path", "left_semi"))
