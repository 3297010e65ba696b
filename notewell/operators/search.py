"""Exact, keyword-overlap and hybrid search, rank fusion and the authority prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.operators import packing
from notewell.plans.dialect import Dialect, SqlOperator

RRF_K = 60
AUTHORITY_WEIGHT = 2.0

# Words and dates of a query that looks back in time.
HISTORY = (
    r"(?iU)\b(conversation|historique|discut|ancien|avant|hier|le \d{1,2}|du \d{1,2}|\d{4}-\d{2}-\d{2}|janvier|fevrier|février|mars|avril|mai|juin|juillet|aout|août|septembre|octobre|novembre|decembre|décembre)\b"
)

# Folders and files that are not indexed.
EXCLUDED = (".trash-mcp/", ".obsidian/", ".trash/", ".trash-wiki-publish/", ".temp/", ".git/", ".staging/", ".claude/", ".hermes/", ".mdinbox/")
EXCLUDED_FILES = ("index.md", "log.md")


def authority(path: Column) -> Column:
    """0 (notes) to 4 (raw material) by folder."""
    return (
        F.when(path.startswith("raw/assets/ConvIA-Analysis/"), 3)
        .when(path.startswith("raw/"), 4)
        .when(path.startswith("wiki/sources/"), 2)
        .when(path.startswith("wiki/"), 1)
        .otherwise(0)
    )


def indexable(path: Column) -> Column:
    out = path.endswith(".md") & ~path.isin(*EXCLUDED_FILES) & ~F.element_at(F.split(path, "/"), -1).startswith("livesync_log_")
    for prefix in EXCLUDED:
        out = out & ~path.startswith(prefix)
    return out


def looks_back(query: Column) -> Column:
    return query.rlike(HISTORY)


def in_folder(notes: DataFrame, folder: str, limit: int = 0) -> DataFrame:
    """Paths that are a folder or lie in it, in order; no limit where it is 0 or less."""
    found = notes.where((F.col("path") == folder) | F.col("path").startswith(folder.rstrip("/") + "/")).select("path").orderBy("path")
    return found.limit(limit) if limit > 0 else found


def exact(notes: DataFrame, needle: str, around: int = 80) -> DataFrame:
    """(path, position, snippet) of the first place of a literal, in any case."""
    at = F.locate(needle.lower(), F.lower("content"))
    first = F.greatest(at - around, F.lit(1))
    snippet = F.trim(F.translate(F.substring("content", first, at + len(needle) + around - first), "\n", " "))
    return notes.where(at > 0).select("path", at.alias("position"), snippet.alias("snippet"))


def query_words(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\w.\-]{2,}"), F.lit(0)))


def keyword_overlap(fragments: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, path, rank, score, position): share of a query's words inside title, preview and path.

    fragments: path, rank, title, preview. queries: query_id, query. Blocks of notes meet blocks of
    queries; one pass over a fragment finds all words of a block, whichever query they are of.
    """
    asked = queries.select("query_id", query_words(F.col("query")).alias("words")).where(F.size("words") > 0)
    held = fragments.select("path", "rank", F.lower(F.concat_ws(" ", "title", "preview", "path")).alias("corpus"))
    kind = queries.schema["query_id"].dataType.simpleString()
    hits = packing.met(held, asked, ["rank"]).mapInArrow(_overlaps(limit), f"query_id {kind}, path string, rank int, found int, n_words int")
    scored = hits.select("query_id", "path", "rank", F.round(F.col("found") / F.col("n_words"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def _overlaps(limit: int):
    """Maps (path, rank, corpus, query_id, words) blocks to the best notes of each query."""

    def run(batches):
        asked, finder, member = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                path, rank, corpus, ids, words = (batch.column(i)[k].values for i in range(5))
                if asked is None or not asked.equals(words):
                    asked, lists = words, words.to_pylist()
                    known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws))}
                    import ahocorasick  # in tasks alone; see requirements.txt

                    finder = ahocorasick.Automaton()
                    for word, i in known.items():
                        finder.add_word(word, i)
                    finder.make_automaton()
                    member = np.zeros((len(known), len(lists)), np.float32)
                    for q, ws in enumerate(lists):
                        member[[known[w] for w in ws], q] = 1
                counts = np.empty((len(corpus), member.shape[1]), np.float32)
                for low in range(0, len(corpus), 512):
                    texts = corpus[low : low + 512].to_pylist()
                    hit = np.zeros((len(texts), len(member)), np.float32)
                    for i, text in enumerate(texts):
                        hit[i, list({w for _, w in finder.iter(text)})] = 1
                    counts[low : low + len(texts)] = hit @ member
                names, ranks, ids = path.to_pylist(), rank.to_numpy(), ids.to_pylist()
                starts = packing.segments(names)
                ends = np.append(starts[1:], len(names))
                most = np.maximum.reduceat(counts, starts, axis=0)
                sizes = member.sum(axis=0).astype(int)
                rows = [
                    (ids[q], names[starts[n]], int(ranks[starts[n] + counts[starts[n] : ends[n], q].argmax()]), int(most[n, q]), int(sizes[q]))
                    for n, q in packing.best(most, limit)
                    if most[n, q] > 0
                ]
                fields = [batch.schema.field(3).type.value_type, pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(fields)], names=["query_id", "path", "rank", "found", "n_words"])

    return run


def fused(lists: DataFrame, limit: int, authority_weight: float = 0.0) -> DataFrame:
    """(query_id, path, score, position) of ranked lists (query_id, list_no, path, position, weight).

    Reciprocal ranks add up, the authority prior joins in, and ties fall to the place in the
    first list, then the second, and so on. Queries with ``looks_back`` true get no prior.
    """
    place = lambda k: F.min(F.when(F.col("list_no") == k, F.col("position"))).alias(f"p{k}")
    summed = lists.groupBy("query_id", "path").agg(
        F.sum(F.col("weight") / (RRF_K + F.col("position"))).alias("s"), F.max("looks_back").alias("looks_back"), place(0), place(1), place(2)
    )
    prior = F.when(F.col("looks_back"), 0.0).otherwise(authority_weight * (4 - authority(F.col("path"))) / 4 / (RRF_K + 1))
    scored = summed.withColumn("score", F.round(F.col("s") + prior, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("p0"), F.asc_nulls_last("p1"), F.asc_nulls_last("p2"), "path")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("query_id", "path", "score", "position")


def pool(limit: int) -> int:
    return max(5 * limit, 20)


def _intent_status(d: Dialect) -> str:
    return """SELECT id, CASE min(CASE place WHEN 'done' THEN 0 WHEN 'failed' THEN 1 WHEN 'queue' THEN 2 ELSE 3 END)
      WHEN 0 THEN 'applied' WHEN 1 THEN 'failed' WHEN 2 THEN 'waiting' ELSE 'unknown' END AS status FROM @intents GROUP BY id"""


intent_status = SqlOperator(("intents",), _intent_status)
