"""Merging of submitted jobs: complete groups of a source's version, committed manifest first.

A group is all chunks of one version (source, source_hash). It merges once every chunk is submitted
and each one's envelope is there and valid; a newer or other version of the source defers it; a group with
an unusable envelope fails alone, and jobs that have failed three times are quarantined.

The commit has two steps that no transaction joins: the manifest of merged groups is written, then the
jobs' new states are published. A crash between them leaves manifest rows of groups that aren't
merged yet; the next run finds the same groups and writes the same rows again under the same number, and
readers take the last row of a path, so nothing is lost and nothing counts twice.

Groups are counts and extrema, combined before the shuffle; no group is gathered. Null sources or
hashes are a version of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.sources.generations import Generations

MAX_ATTEMPTS = 3
GROUP = ["source", "source_hash"]


def group_outcomes(jobs: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(source, source_hash, chunk_count, submitted, outcome) of every group with submitted jobs.

    jobs: source, source_hash, chunk_index, chunk_count, status; envelopes: source_hash, chunk_index, ok (one row or none
    a chunk; the worst counts if there are more). Outcomes: incomplete, stale, failed, merged.
    """
    checked = envelopes.groupBy(F.col("source_hash").alias("of_hash"), F.col("chunk_index").alias("of_chunk")).agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
    asked = jobs.where("status IN ('submitted', 'merged')")
    met = asked.join(checked, F.col("source_hash").eqNullSafe(F.col("of_hash")) & F.col("chunk_index").eqNullSafe(F.col("of_chunk")), "left")
    submitted = F.col("status") == "submitted"
    groups = met.groupBy(*GROUP).agg(
        F.max("chunk_count").alias("chunk_count"), F.count(F.when(submitted, 1)).alias("submitted"), F.count(F.when(submitted & ~F.coalesce("ok", F.lit(False)), 1)).alias("unusable")
    )
    versions = jobs.groupBy(F.col("source").alias("of")).agg(F.countDistinct(F.coalesce("source_hash", F.lit(""))).alias("versions"))
    judged = groups.where("submitted > 0").join(versions, F.col("source").eqNullSafe(F.col("of")))
    total = F.coalesce("chunk_count", F.lit(0))
    outcome = F.when((total <= 0) | (F.col("submitted") < total), "incomplete").when(F.col("versions") > 1, "stale").when(F.col("unusable") > 0, "failed").otherwise("merged")
    return judged.select(*GROUP, "chunk_count", "submitted", outcome.alias("outcome"))


def merged_jobs(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The jobs after a merge: status, attempts and last_error of the submitted jobs of decided groups change."""
    decided = outcomes.where("outcome <> 'incomplete'").select(F.col("source").alias("of"), F.col("source_hash").alias("of_hash"), "outcome")
    joined = jobs.join(decided, F.col("source").eqNullSafe(F.col("of")) & F.col("source_hash").eqNullSafe(F.col("of_hash")) & (F.col("status") == "submitted"), "left")
    tried = F.coalesce("attempts", F.lit(0)) + F.when(F.col("outcome").isin("stale", "failed"), 1).otherwise(0)
    status = (
        F.when(F.col("outcome") == "merged", "merged").when(F.col("outcome") == "stale", "deferred")
        .when((F.col("outcome") == "failed") & (tried >= MAX_ATTEMPTS), "quarantined").otherwise(F.col("status"))
    )
    error = F.when(F.col("outcome") == "stale", "stale: another version of the source").when(F.col("outcome") == "failed", "unusable envelope").otherwise(jobs["last_error"] if "last_error" in jobs.columns else F.lit(None))
    kept = [jobs[c] for c in jobs.columns if c not in ("status", "attempts", "last_error")]
    return joined.select(*kept, status.alias("status"), tried.cast("bigint").alias("attempts"), error.cast("string").alias("last_error"))


def manifest_rows(outcomes: DataFrame, number: int) -> DataFrame:
    """(path, sha256, chunks, run) of the merged groups."""
    return outcomes.where("outcome = 'merged'").select(F.col("source").alias("path"), F.col("source_hash").alias("sha256"), F.col("chunk_count").cast("bigint").alias("chunks"), F.lit(number).cast("bigint").alias("run"))


class MergeStore:
    """The jobs' states as generations, and the manifest as one folder a run beside them."""

    def __init__(self, states: Generations) -> None:
        self.states, self.spark = states, states.spark

    def _manifest(self, number: int) -> str:
        return f"{self.states.root}/manifest/run={number}"

    def merge(self, envelopes: DataFrame) -> DataFrame:
        """One run over the current jobs; gives the outcomes of the groups."""
        number = self.states.begin()
        jobs = self.states.read("jobs")
        self.states.write(number, {"outcomes": group_outcomes(jobs, envelopes)})
        outcomes = self.spark.read.parquet(self.states.table_path(number, "outcomes"))
        manifest_rows(outcomes, number).drop("run").write.mode("overwrite").parquet(self._manifest(number))
        self.states.publish({"jobs": merged_jobs(jobs, outcomes)}, number)
        return outcomes

    def manifest(self) -> DataFrame:
        """(path, sha256, chunks, run): the last row of each path."""
        rows = self.spark.read.schema("path string, sha256 string, chunks bigint, run bigint").parquet(f"{self.states.root}/manifest")
        return rows.groupBy("path").agg(F.max_by(F.struct("sha256", "chunks", "run"), "run").alias("m")).select("path", "m.*")
