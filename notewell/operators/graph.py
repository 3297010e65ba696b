"""The link graph: wikilinks, backlinks, outgoing links and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.plans.dialect import Dialect, SqlOperator

# Fixed value: a wikilink; the target ends at an anchor or an alias.
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def wikilinks(notes: DataFrame) -> DataFrame:
    """(source, position, target) of every wikilink of notes (path, content)."""
    targets = F.regexp_extract_all("content", F.lit(WIKILINK), F.lit(1))
    return notes.select(F.col("path").alias("source"), F.posexplode(targets).alias("position", "target")).select("source", "position", F.trim("target").alias("target"))


def _backlinks(d: Dialect) -> str:
    return "SELECT target, count(DISTINCT source) AS n_sources, count(*) AS n_links, min(source) AS first_source FROM @links GROUP BY target"


def _citing(d: Dialect) -> str:
    return """SELECT n.path, n.name, count(DISTINCT CASE WHEN l.source <> n.path THEN l.source END) AS n_backlinks, count(DISTINCT l.source) AS n_with_self
      FROM @names n LEFT JOIN @links l ON l.target = n.name GROUP BY n.path, n.name"""


def _outgoing(d: Dialect) -> str:
    return """SELECT l.source, l.target, n.n_paths IS NOT NULL AS resolved, coalesce(n.n_paths, 0) AS n_paths, n.first_path
      FROM (SELECT DISTINCT source, target FROM @links) l LEFT JOIN (SELECT name, count(path) AS n_paths, min(path) AS first_path FROM @names GROUP BY name HAVING count(path) > 0) n ON l.target = n.name"""


_REPAIR = """SELECT t.target, t.n_notes, CASE WHEN min(e.path) IS NOT NULL THEN 'healthy' WHEN count(DISTINCT c.name) = 1 THEN 'repaired' WHEN count(DISTINCT c.name) > 1 THEN 'ambiguous' ELSE 'none' END AS state,
      CASE WHEN min(e.path) IS NULL AND count(DISTINCT c.name) = 1 THEN min(c.name) END AS replacement
      FROM (SELECT target, count(DISTINCT source) AS n_notes FROM @links GROUP BY target) t
      LEFT JOIN (SELECT name, min(path) AS path FROM @names GROUP BY name) e ON e.name = t.target
      LEFT JOIN (SELECT DISTINCT name, lower(name) AS folded FROM @names) c ON c.folded = lower(t.target) AND c.name <> t.target
      GROUP BY t.target, t.n_notes"""


def _repair(d: Dialect) -> str:
    return _REPAIR


def _repair_report(d: Dialect) -> str:
    return f"SELECT state, count(*) AS n_targets, sum(n_notes) AS n_notes FROM ({_REPAIR}) r GROUP BY state"


def _rename_impact(d: Dialect) -> str:
    return """SELECT n.path, n.name, CASE WHEN c.n > 1 THEN 'ambiguous' ELSE 'rewritten' END AS outcome, count(DISTINCT CASE WHEN l.source <> n.path THEN l.source END) AS n_rewritten
      FROM @names n JOIN (SELECT name, count(DISTINCT path) AS n FROM @names GROUP BY name) c ON c.name = n.name LEFT JOIN @links l ON l.target = n.name GROUP BY n.path, n.name, c.n"""


def _cited(names: DataFrame, links: DataFrame) -> DataFrame:
    """(path, name, n_backlinks, n_with_self) of every note: how many notes link to its name, without and with itself.

    Links are counted by target before they meet notes, so notes of one name are never paired with all links to it.
    """
    pairs = links.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    counts = pairs.groupBy(F.col("target").alias("cited")).agg(F.count("*").alias("n"))
    held = names.select("path", "name").distinct()
    own = pairs.withColumn("own", F.lit(1))
    met = held.join(counts, F.col("name") == F.col("cited"), "left").join(own, (F.col("path") == F.col("source")) & (F.col("name") == F.col("target")), "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return met.select("path", "name", F.when(F.col("path").isNull(), F.lit(0).cast("bigint")).otherwise(n - F.coalesce("own", F.lit(0))).alias("n_backlinks"), n.alias("n_with_self"))


def _renamed(names: DataFrame, links: DataFrame) -> DataFrame:
    """What renaming each note would rewrite; only a name that one path has can be told."""
    told = names.where("name IS NOT NULL").groupBy(F.col("name").alias("told")).agg(F.countDistinct("path").alias("n"))
    met = _cited(names, links).join(told, F.col("name") == F.col("told"))
    return met.select("path", "name", F.when(F.col("n") > 1, "ambiguous").otherwise("rewritten").alias("outcome"), F.col("n_backlinks").alias("n_rewritten"))


backlinks = SqlOperator(("links",), _backlinks)
citing_notes = SqlOperator(("names", "links"), _citing, _cited)
outgoing = SqlOperator(("links", "names"), _outgoing)
link_repair = SqlOperator(("links", "names"), _repair)
repair_report = SqlOperator(("links", "names"), _repair_report)
rename_impact = SqlOperator(("names", "links"), _rename_impact, _renamed)


def slug_collisions(names: DataFrame) -> DataFrame:
    """(slug, path, n_others, first_other) of the notes (path, name) whose name other notes have as well.

    A name's count and its two smallest paths tell all; notes of one name are never paired.
    """
    held = names.where("path is not null").select(F.col("name").alias("slug"), "path").distinct()
    first = held.groupBy("slug").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    met = held.join(first, "slug")
    second = met.where("path <> first").groupBy("slug").agg(F.min("path").alias("second"))
    return met.join(second, "slug").select("slug", "path", (F.col("n") - 1).alias("n_others"), F.when(F.col("path") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("first_other"))
