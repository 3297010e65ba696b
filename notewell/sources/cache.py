"""A content-addressed cache of vectors, and tables of days with retention.

The cache is a table of generations whose rows are keyed by content (``path`` is the key): each use
writes the rows it has seen, with the time, on top of the last generation; readers take a key's last
row. What hasn't been seen for some days is left out when the cache is purged, which writes one whole
generation. Vectors are made anew if they are asked for again, so a purge loses no data.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.sources.generations import Generations

ROWS = "path string, vector array<float>, seen_at bigint"
DAY_S = 86_400
#: Generations of uses that a reader should meet at most.
MAX_DELTAS = 20


def content_key(text: F.Column, model: str) -> F.Column:
    """The key of a text's vector by a model."""
    return F.sha2(F.concat(F.lit(f"{model}\x00"), text).cast("binary"), 256)


class VectorCache:
    def __init__(self, store: Generations, model: str) -> None:
        self.store, self.model, self.spark = store, model, store.spark

    def rows(self) -> DataFrame:
        """(path, vector, seen_at) of all that is held; path is the key."""
        return self.store.read("vectors") if self.store.current() is not None else self.spark.createDataFrame([], ROWS)

    def vectors(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], now_s: int) -> DataFrame:
        """(path, vector, hit) of the distinct texts (text), which are in the cache then, seen at ``now_s``.

        ``embed`` is given the (path, text) of those missing and gives (path, vector). Null texts are left out.
        """
        wanted = texts.where("text is not null").select(content_key(F.col("text"), self.model).alias("path"), "text").groupBy("path").agg(F.min("text").alias("text"))
        held = self.rows()
        number = self.store.begin()
        hits = wanted.select("path").join(held, "path").select("path", "vector", F.lit(True).alias("hit"))
        made = embed(wanted.join(held, "path", "left_anti")).select("path", F.col("vector").cast("array<float>").alias("vector"), F.lit(False).alias("hit"))
        self.store.write(number, {"used": hits.unionByName(made)})
        used = self.spark.read.parquet(self.store.table_path(number, "used"))
        rows = {"vectors": used.select("path", "vector", F.lit(now_s).cast("bigint").alias("seen_at"))}
        if self.store.current() is None:
            self.store.publish(rows, number)
        else:
            self.store.append(number, {"touched": used.select("path")} | rows)
            if len(self.store.manifest()["deltas"]) >= MAX_DELTAS:
                self.store.compact()
        return used

    def purge(self, now_s: int, days: int = 30) -> int:
        """Leave out what was seen last over ``days`` days ago; gives how many vectors went."""
        held = self.rows()
        limit = now_s - max(1, days) * DAY_S
        gone = held.where(F.col("seen_at") < limit).count()
        if gone:
            self.store.publish({"vectors": held.where(F.col("seen_at") >= limit)}, 0)
        return gone


class DayTable:
    """An append-only table in folders by day, of which old ones are dropped."""

    def __init__(self, spark: SparkSession, root: str, moment: str) -> None:
        self.spark, self.root, self.moment = spark, root.rstrip("/"), moment
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def days(self) -> list[str]:
        """The days that have a folder, ascending."""
        if not self._fs.exists(self._path("")):
            return []
        return sorted(n[4:] for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if n.startswith("day="))

    def append(self, rows: DataFrame) -> None:
        """Add rows; those without a moment aren't kept."""
        day = F.date_format(F.col(self.moment).cast("timestamp"), "yyyy-MM-dd")
        rows.where(F.col(self.moment).isNotNull()).withColumn("day", day).write.mode("append").partitionBy("day").parquet(self.root)

    def read(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", False).parquet(self.root).drop("day")

    def purge(self, now: datetime.datetime, days: int = 30) -> list[str]:
        """Drop what is older than ``days`` days: folders of whole days, and the older part of the day of the limit.

        Nothing younger goes, and running it again changes nothing. The rest of the limit's day is
        written beside its folder first and takes its place by renames, so a broken purge can be run again.
        """
        limit = now - datetime.timedelta(days=days)
        edge = limit.strftime("%Y-%m-%d")
        for day in self.days():
            rest, own = self._path(f".rest-{day}"), self._path(f"day={day}")
            if day < edge:
                self._fs.delete(own, True)
            elif day == edge:
                held = self.spark.read.parquet(f"{self.root}/day={day}")
                late = held.where(F.col(self.moment).cast("timestamp") >= F.lit(limit.isoformat(sep=" ")).cast("timestamp"))
                if late.count() < held.count():
                    late.write.mode("overwrite").parquet(f"{self.root}/.rest-{day}")
                    self._fs.delete(own, True)
                    if not self._fs.rename(rest, own):
                        raise OSError(f"day {day} can't be replaced")
        return self.days()
