"""Note files as rows: recursive Markdown scans, decoding, and the other file shapes of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.operators.search import indexable

MAX_BYTES = 8 * 1024 * 1024


def decoded(raw: F.Column) -> F.Column:
    """UTF-8 with broken bytes replaced and all line ends as newlines."""
    return F.regexp_replace(F.call_function("make_valid_utf8", raw.cast("string")), r"\r\n?", "\n")


def read_notes(spark: SparkSession, root: str, pattern: str = "*.md", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, raw, modified, reason) of the indexable notes under ``root``.

    Files over ``max_bytes`` aren't opened (their size is file metadata); they keep their row, with
    null content and the reason.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "^" + _quoted(base) + "/", "").alias("path")
    modified = F.col("modificationTime").alias("modified")
    small = files.where(F.col("length") <= max_bytes).select(relative, decoded(F.col("content")).alias("content"), F.col("content").alias("raw"), modified, F.lit(None).cast("string").alias("reason"))
    reason = F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes: "), F.col("length")).alias("reason")
    large = files.where(F.col("length") > max_bytes).select(relative, F.lit(None).cast("string").alias("content"), F.lit(None).cast("binary").alias("raw"), modified, reason)
    return small.unionByName(large).where(indexable(F.col("path")))


def read_note(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The row of one note: only its file is listed and opened."""
    return read_notes(spark, f"{root.rstrip('/')}/{path}", "*").withColumn("path", F.lit(path))


def _quoted(text: str) -> str:
    plain = text.split("://", 1)[-1] if "://" in text else text.removeprefix("file:")
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in "/" + plain.lstrip("/"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, famille, texte) of a JSON query set."""
    rows = spark.read.schema("requetes array<struct<id:int,famille:string,texte:string>>").json(path, multiLine=True)
    return rows.select(F.explode("requetes").alias("r")).select("r.*")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The text, step and error events of a log with one JSON object a line; other lines are skipped."""
    event = F.from_json("value", "type string, part struct<text:string,reason:string>, error string")
    return spark.read.text(path).select(event.alias("e")).where(F.col("e.type").isin("text", "step_finish", "error")).select("e.type", "e.part.text", "e.part.reason", "e.error")


def last_wins(manifest: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only table."""
    columns = [c for c in manifest.columns if c != key]
    return manifest.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of wanted texts (text), those with a vector in the cache (key, vector) and the keys still to embed."""
    keyed = wanted.select(F.sha2(F.concat(F.lit("model\x00"), F.col("text")).cast("binary"), 256).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")
