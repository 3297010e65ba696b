"""Checks before a write: note and folder paths, a namespace, and whether an analysis is accepted."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.operators.editing import normal_path, stripped

# Zones where nothing is written, zones that are hidden from readers as well, and root notes that no index holds.
FORBIDDEN = (".hermes/", ".staging/", ".obsidian/", ".trash/", ".temp/")
EXCLUDED = (".git/", ".claude/", ".mdinbox/", ".trash-mcp/")
UNINDEXED = ("index.md", "log.md")
RESERVED_NAME = "livesync_log_"

MAX_NOTE_BYTES = 1 << 20
#: Characters of the longest analysis that is taken.
MAX_ANALYSIS = 60_000


def _within(path: Column, zones: tuple[str, ...]) -> Column:
    return reduce(or_, (path.startswith(z) for z in zones))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def write_checks(notes: DataFrame, max_bytes: int = MAX_NOTE_BYTES) -> DataFrame:
    """``notes`` (path, content, …) with ``normal`` and ``reason``: where a note may be written, or why not.

    A null content is a check of the path alone. The first reason that holds is given; ``normal`` is
    null with a reason.
    """
    normal, reason = normal_path(F.col("path"))
    held = notes.withColumn("normal", normal).withColumn("reason", reason)
    at = F.col("normal")
    further = (
        F.when(_within(at, FORBIDDEN), "forbidden zone")
        .when(_within(at, EXCLUDED), "excluded")
        .when(_name(at).startswith("."), "hidden name")
        .when(_name(at).startswith(RESERVED_NAME), "reserved name")
        .when(at.isin(*UNINDEXED), "not indexed")
        .when(F.octet_length("content") > max_bytes, "too large")
    )
    held = held.withColumn("reason", F.coalesce("reason", further))
    return held.withColumn("normal", F.when(F.col("reason").isNull(), at))


def folder_checks(folders: DataFrame) -> DataFrame:
    """``folders`` (path, …) with ``normal`` and ``reason``; a folder's name doesn't end like a note's."""
    normal, reason = normal_path(F.col("path"), markdown=False)
    held = folders.withColumn("normal", normal).withColumn("reason", reason)
    at = F.col("normal")
    further = (
        F.when(_within(at, FORBIDDEN), "forbidden zone")
        .when(_within(at, EXCLUDED), "excluded")
        .when(_name(at).startswith("."), "hidden name")
        .when(at.endswith(".md"), "note name")
    )
    held = held.withColumn("reason", F.coalesce("reason", further))
    return held.withColumn("normal", F.when(F.col("reason").isNull(), at))


def confined(path: Column, namespace: str) -> tuple[Column, Column]:
    """A path below ``namespace`` and the reason of a refusal, which comes before any resolution."""
    clean = F.ltrim(F.replace(stripped(path), F.lit("\\"), F.lit("/")), F.lit("/"))
    reason = (
        F.when(clean.isNull() | (clean == ""), "empty")
        .when(F.array_contains(F.split(clean, "/"), "..") | F.contains(clean, F.lit("\x00")), "traversal")
        .when(~clean.startswith(namespace), "outside")
    )
    return clean, reason


def analysis_outcomes(requests: DataFrame, mirror: DataFrame, queue: DataFrame, namespace: str, version: str) -> DataFrame:
    """``requests`` (source_path, source_hash, analysis_version, markdown, …) with ``clean`` and ``outcome``.

    ``mirror`` (source_path, source_hash) are the sources as they stand, one row each; ``queue``
    (event_id, source_path, source_hash, status) what was analysed. A source that is done already
    is a ``duplicate``: a replay, not a failure. Both sides meet the requests by equality alone.
    """
    clean, refused = confined(F.col("source_path"), namespace)
    asked = requests.withColumn("clean", clean).withColumn("refused", refused)
    now = mirror.select(F.col("source_path").alias("clean"), F.col("source_hash").alias("current"))
    newest = queue.groupBy(F.col("source_path").alias("clean"), "source_hash").agg(F.max_by("status", "event_id").alias("held"))
    outcome = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(~F.col("analysis_version").eqNullSafe(version), "version")
        .when(F.coalesce(stripped(F.col("markdown")), F.lit("")) == "", "no text")
        .when(F.char_length("markdown") > MAX_ANALYSIS, "too long")
        .when(F.col("current").isNull(), "not found")
        .when(~F.col("current").eqNullSafe(F.col("source_hash")), "stale hash")
        .when(F.col("held") == "done", "duplicate")
        .otherwise("accepted")
    )
    met = asked.join(now, "clean", "left").join(newest, ["clean", "source_hash"], "left")
    return met.withColumn("outcome", outcome).drop("refused", "current", "held")
