"""The thin opN queries: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm import debruijn, decontaminate, jaccard, licences, mixing, neural, privacy, ranking, repetition, runs, secrets, spelling, warc
from notewell.llm.common import sha256_of, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "status")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = repetition.repetition_rules(docs, "rules", keep=["doc_id"])
    return judged.select(
        "doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat")]
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ranking.fit(docs, table(spark, sf_dir, "labels"))
    scored = ranking.quality_scores(docs, "made", model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(ranking.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "made.score", "made.predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs, "found", secrets.infer_formats(docs), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter("found.base", _of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in secrets.KINDS],
        sha256_of(joined("found.base")).alias("base_sha256"),
        joined("found.spans").alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.suffix_matches(docs, table(spark, sf_dir, "benchmark"), "found", keep=["doc_id"])
    items = F.array_sort(F.array_compact(F.array_distinct(F.transform("found.matches", lambda m: m["item_id"]))))
    longest = F.array_max(F.transform("found.matches", lambda m: m["n_words"]))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        sha256_of(F.array_join(items, ",")).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
        F.coalesce(longest, F.lit(0)).cast("bigint").alias("longest_match"),
    )


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in privacy.KINDS],
        sha256_of(joined("spans")).alias("base_sha256"),
        joined(F.concat("spans", "terms")).alias("spans"),
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.license_spans(docs, "found", keep=["doc_id"])
    return found.select(
        "doc_id",
        *[f"found.{c}" for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join("found.base_labels", ",").alias("base_labels"),
        F.array_join("found.labels", ",").alias("labels"),
        "found.score",
        F.array_join(F.transform("found.spans", lambda s: F.concat_ws(":", s["label"], s["doc_start"], s["doc_end"])), ",").alias("spans"),
    )


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = debruijn.remove_repeated(docs, "left", with_text=False, keep=["doc_id"])
    return left.select("doc_id", *[f"left.{c}" for c in ("n_words", "n_removed", "kept_sha256")])


def op11_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, model = neural.language_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), "made")
    return made.select(
        "doc_id",
        neural.held_out(F.col("doc_id")).alias("held_out"),
        "made.n_tokens",
        "made.n_known",
        F.lit(model.lexicon.tokens).cast("bigint").alias("train_tokens"),
        "made.base_score",
        "made.score",
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.collapsed(docs, "found", F.crc32(F.col("doc_id").cast("string").cast("binary")), keep=["doc_id"]).withColumn("best", runs.strongest(F.col("found.runs")))
    lines = F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("found.runs").cast("bigint").alias("n_runs"),
        *[f"best.{c}" for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        sha256_of(F.array_join(lines, "")).alias("runs_sha256"),
        sha256_of(F.col("found.collapsed")).alias("collapsed_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
