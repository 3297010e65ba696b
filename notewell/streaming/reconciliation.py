"""Reconciliation of a mirror of notes with the index, by a high-water mark that survives restarts.

A pass compares the paths of both sides and, of the paths on both, takes those whose file was written
at the mark or after it (by change time or by modification time, whichever is later: a synchroniser
copies modification times, so late writes carry early ones). The mark is the time at which the last
complete pass *began*; it advances only once all that a pass found has been queued, so a pass that breaks, or
finds more than it may queue, hides nothing from the next one. A mark in the future (a clock set
back) is ignored, and so is a missing one: then only the two sets of paths are compared.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaps(mirror: DataFrame, index: DataFrame, mark_ns) -> DataFrame:
    """(path, reason) of the notes to index anew: ``created``, ``removed`` or ``written``.

    mirror: path, change_ns, modified_ns (null where unknown); index: path; mark_ns: a column or number, null or 0
    for none. A path that is listed more than once counts with its latest time.
    """
    mark = mark_ns if isinstance(mark_ns, F.Column) else F.lit(mark_ns).cast("bigint")
    held = mirror.groupBy("path").agg(F.max(F.greatest("change_ns", "modified_ns")).alias("written_ns"))
    known = index.select(F.col("path").alias("known")).distinct()
    both = held.join(known, F.col("path") == F.col("known"), "full_outer")
    reason = F.when(F.col("known").isNull(), "created").when(F.col("path").isNull(), "removed").when((mark > 0) & (F.col("written_ns") >= mark), "written")
    return both.select(F.coalesce("path", "known").alias("path"), reason.alias("reason")).where("path is not null and reason is not null")


class Mark:
    """A number in a file of the shared folder, replaced by one rename; broken or missing files read as 0."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _marks(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[5:]) for n in names if n.startswith("mark-") and n[5:].isdigit())

    def read(self) -> int:
        return max(self._marks(), default=0)

    def advance(self, to_ns: int) -> None:
        """Set the mark; it may also go back, from a time in the future."""
        before = self._marks()
        self._fs.mkdirs(self._path(""))
        made = self._path(f".mark-{to_ns}")
        self._fs.create(made, True).close()
        if to_ns not in before and not self._fs.rename(made, self._path(f"mark-{to_ns}")):
            raise OSError(f"the mark {to_ns} can't be set")
        for old in before:
            if old != to_ns:
                self._fs.delete(self._path(f"mark-{old}"), False)


def reconcile(mark: Mark, scan: Callable[[], DataFrame], index: DataFrame, queue: Callable[[DataFrame], None], most: int | None = None, clock: Callable[[], int] = time.time_ns) -> str:
    """One pass: what ``gaps`` finds goes to ``queue``, then the mark advances. Gives the pass' outcome.

    ``scan`` lists the mirror and ``queue`` must have kept its rows when it returns; if either raises, so does
    this, and the mark stays. With ``most``, a pass that finds more queues nothing (``too many``: a
    rebuild is cheaper) and the mark stays.
    """
    began = clock()
    held = mark.read()
    found = gaps(scan(), index, held if held <= began else 0)
    if most is not None and found.limit(most + 1).count() > most:
        return "too many"
    queue(found)
    mark.advance(began)
    return "complete"
