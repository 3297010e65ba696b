"""Index generations: tables written side by side, published by one small file.

Tables of a generation go to ``<root>/gen=<n>/<name>``. A generation counts from the moment its
``manifest-<n>.json`` exists, which one rename of a finished file makes; readers take the largest
number. So they see the old generation or the new one, never a mix and never none, and a writer
that dies at any step leaves the old one published. Paths go through Hadoop's file systems.

A generation is a whole index, or the changes of a batch on top of an earlier one: ``touched`` (the
paths that the batch speaks for), new rows of tables by path, and signed rows of sums. Readers take
a path's rows from the last generation that touched it and add the sums up, so a batch costs what
it changes, not what the index holds. ``compact`` makes one whole generation again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.sources.scratch import input_bytes, slices

#: Files of touched paths up to this are small enough to be sent to all tasks; a join with more shuffles the rows.
TOUCHED_BYTES = 256 << 10
_MANIFEST = re.compile(r"manifest-(\d+)\.json")


class Generations:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def published(self) -> list[int]:
        """The numbers of all published generations, ascending."""
        return sorted(int(m[1]) for m in map(_MANIFEST.fullmatch, self._names()) if m)

    def current(self) -> int | None:
        """The published generation, if there is one."""
        return max(self.published(), default=None)

    def manifest(self) -> dict:
        """What the current generation says of itself; empty if there is none."""
        number = self.current()
        if number is None:
            return {}
        held = json.loads(self._text(f"manifest-{number}.json"))
        return {"base": number, "deltas": [], "sums": {}, "streams": {}} | held

    def _text(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def applied(self, stream: str = "") -> int | None:
        """The last batch of a stream that the current generation holds."""
        return self.manifest().get("streams", {}).get(stream)

    def _next(self, now_ns: int) -> int:
        held = self.current()
        return max(now_ns, held + 1 if held is not None else now_ns)

    def table_path(self, number: int, name: str) -> str:
        return f"{self.root}/gen={number}/{name}"

    def write(self, number: int, tables: dict[str, DataFrame]) -> None:
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(self.table_path(number, name))

    def _publish(self, number: int, **said) -> int:
        out = self._fs.create(self._path(f".manifest-{number}"), True)
        out.write(bytearray((json.dumps({"generation": number} | said) + "\n").encode()))
        out.close()
        self._commit(number)
        return number

    def publish(self, tables: dict[str, DataFrame], now_ns: int, sums: dict[str, list[str]] | None = None, streams: dict[str, int] | None = None) -> int:
        """Write all tables as a new whole generation, then make it current; numbers only rise.

        ``sums`` names the tables that add up, with their keys. Batches that earlier streams have applied stay known.
        """
        number = self._next(now_ns)
        self.write(number, tables)
        return self._publish(number, base=number, tables=sorted(tables), sums=sums or {}, streams=self.manifest().get("streams", {}) | (streams or {}))

    def begin(self, now_ns: int = 0) -> int:
        """The number that a batch of changes may write under."""
        return self._next(now_ns)

    def append(self, number: int, tables: dict[str, DataFrame], streams: dict[str, int] | None = None) -> int:
        """Publish the changes of a batch on top of the current generation: ``touched``, rows by path, signed sums.

        Tables of the batch that its writer has written already need not be given.
        """
        held = self.manifest()
        self.write(number, tables)
        return self._publish(number, base=held["base"], tables=held["tables"], sums=held["sums"], deltas=[*held["deltas"], number], streams=held["streams"] | (streams or {}))

    def compact(self, now_ns: int = 0) -> int:
        """The same index as one whole generation."""
        held = self.manifest()
        return self.publish({name: self.read(name) for name in held["tables"]}, now_ns, held["sums"])

    def _commit(self, number: int) -> None:
        if not self._fs.rename(self._path(f".manifest-{number}"), self._path(f"manifest-{number}.json")):
            raise OSError(f"generation {number} can't be published")

    def read(self, name: str, paths: DataFrame | None = None) -> DataFrame:
        """A table of the current generation: a path's rows of the last batch that touched it, sums of all.

        ``paths`` (distinct, column ``path``) keeps the rows of those alone: each path's generation is looked up first, and
        rows meet one small table of both, so no row of another path is dealt.
        """
        held = self.manifest()
        base = self.spark.read.parquet(self.table_path(held["base"], name))
        if not held["deltas"]:
            return base if paths is None else base.join(paths, "path", "left_semi")
        numbered = lambda n, which: self.spark.read.schema(base.schema if which == name else "path string").parquet(self.table_path(n, which)).withColumn("_gen", F.lit(n))
        rows = base.withColumn("_gen", F.lit(held["base"]))
        for number in held["deltas"]:
            rows = rows.unionByName(numbered(number, name))
        if name in held["sums"]:
            keys = held["sums"][name]
            added = rows.groupBy(*keys).agg(*[F.sum(c).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in keys])
            return added.where(F.greatest(F.lit(0), *[F.col(c) for c in base.columns if c not in keys]) > 0).select(*base.columns) if keys else added.select(*base.columns)
        touched = numbered(held["deltas"][0], "touched")
        for number in held["deltas"][1:]:
            touched = touched.unionByName(numbered(number, "touched"))
        last = touched.groupBy("path").agg(F.max("_gen").alias("_last"))
        if paths is not None:
            wanted = paths.join(last, "path", "left").select("path", F.coalesce("_last", F.lit(held["base"])).alias("_gen"))
            return rows.join(wanted, ["path", "_gen"], "left_semi").select(*base.columns)
        if input_bytes(touched) > TOUCHED_BYTES:
            # the shuffle that the join makes anyway, with partitions in proportion to the rows
            parts = max(slices(rows), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows, last = rows.repartition(parts, "path"), last.repartition(parts, "path")
        return rows.join(last, "path", "left").where(F.col("_gen") == F.coalesce("_last", F.lit(held["base"]))).select(*base.columns)

    def purge(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` generations; the current one, what it builds on and what a writer may still write stay."""
        current, held = self.current(), self.manifest()
        needed = {held.get("base"), *held.get("deltas", [])}
        numbers = sorted(int(n[4:]) for n in self._names() if n.startswith("gen="))
        gone = [n for n in numbers[: max(0, len(numbers) - keep)] if current is not None and n < current and n not in needed]
        for n in gone:
            self._fs.delete(self._path(f"manifest-{n}.json"), False)
            self._fs.delete(self._path(f"gen={n}"), True)
        return gone
