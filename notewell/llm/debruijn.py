"""Substring dedup on the De Bruijn graph of token k-mers.

The edges of the graph are the windows of ``size`` (k) words, each leading from its first k-1
words to its last. An edge that stands in several documents is repeated. All edges around one
minimizer (the least hash of the short word runs inside a window) travel as one row, so equal
edges meet without a row each; a sorted pass over every key finds the smallest document of each
edge and its place there. Consecutive repeated edges with one source and one diagonal have no
branch between them and compact into paths.

Edges meet by hashes (64 bits for the minimizer and 48 for the window), so every path is verified
by its source coordinates: the words at its place and the words at the source's place, read from
the texts again, must have one SHA-256. Paths that differ are left alone. Joined back to their
documents, the verified paths say which words repeat an earlier document.

Scale: rows are spread by minimizer. An exact count of all keys (combined before its shuffle) finds
those with ``hot_rows`` rows or more, which go another way that splits: equal runs of windows take
a partial minimum before the shuffle and join it again, where adaptive execution splits hot
partitions, and only the runs of no smaller document are looked up edge by edge. The list of hot
keys is the ``MAX_HOT`` most frequent ones, 8 bytes each, so no other key has more than that share
of the rows; keys beyond it are still exact.

Defined results: a null text has no words; a row with a null doc_id loses nothing and is no
source; rows that repeat a doc_id never remove from each other, and texts under one doc_id are told
apart by 64 bits of their own; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.llm.common import Workspace, blocks, fresh_name, space_words, with_struct
from notewell.llm.grams import PartialCounts, gram_hashes, least_in_windows, word_hashes

SIZE = 13
MINIMIZER = 4
HOT_ROWS = 5_000
MAX_HOT = 1_000_000
_WINDOW_BYTES = 6

EDGES = "key bigint, doc_id bigint, text_id bigint, start int, windows binary"
PLACES = "doc_id bigint, text_id bigint, start int, n int, source_doc bigint, source_text bigint, source_start int, looped boolean"
PATH = [c.split()[0] for c in PLACES.split(", ")]


class EdgeRows:
    """Runs of windows with one minimizer: key, document, first start and the window hashes.

    Runs go by the minimizer's value, not its place, so that a loop of the graph (periodic text)
    is one row of its document.
    """

    def __init__(self, ids: list[int], own: list[int], texts: list[bytes], size: int, minimizer: int) -> None:
        words, bounds, _ = word_hashes(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        windows = gram_hashes(words, size)
        whole = np.flatnonzero(doc[: len(windows)] == doc[size - 1 :][: len(windows)])
        short = gram_hashes(words, minimizer)
        best = least_in_windows(short, size - minimizer + 1)[whole] if len(whole) else whole
        heads = np.flatnonzero(np.append(True, (np.diff(short[best]) != 0) | (np.diff(doc[whole]) != 0))) if len(whole) else whole
        owner = doc[whole[heads]]
        self.key, self.doc, self.text = short[best[heads]], np.array(ids, np.int64)[owner], np.array(own, np.int64)[owner]
        self.start = (whole[heads] - bounds[owner]).astype(np.int32)
        self.count, self.windows = np.diff(np.append(heads, len(whole))), windows[whole]

    def chosen(self, mask: np.ndarray) -> EdgeRows:
        out = object.__new__(EdgeRows)
        out.windows = self.windows[np.repeat(mask, self.count)]
        out.key, out.doc, out.text, out.start, out.count = self.key[mask], self.doc[mask], self.text[mask], self.start[mask], self.count[mask]
        return out


def _hot_mask(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def _text_id(text) -> F.Column:
    """64 bits that tell the texts under one doc_id apart."""
    return F.xxhash64(text.cast("string").cast("binary"))


def _edge_blocks(batches, size: int, minimizer: int):
    """Edge rows of the blocks of Arrow batches of (doc_id, text_id, text)."""
    for batch in batches:
        ids, own, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        for block in blocks(batch.column(2).to_pylist()):
            yield EdgeRows(ids[at : at + len(block)], own[at : at + len(block)], block, size, minimizer)
            at += len(block)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, text) of the rows that take part."""
    held = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return held.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_id(F.col("text")).alias("text_id"), F.col("text").cast("string").cast("binary").alias("text"))


def hot_keys(docs: DataFrame, size: int, minimizer: int, hot_rows: int) -> np.ndarray:
    """The keys with the most rows, at most MAX_HOT, in ascending order."""

    def count(batches):
        tally = PartialCounts()
        for edges in _edge_blocks(batches, size, minimizer):
            if part := tally.add(edges.key):
                yield counted(part)
        if part := tally.flush():
            yield counted(part)

    def counted(part) -> pa.RecordBatch:
        keys, n = part
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], names=["key", "n"])

    found = _texts(docs).mapInArrow(count, "key bigint, n int").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_rows)
    return np.sort(found.orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key").toArrow().column("key").to_numpy().view(np.uint64))


def _packed(edges: EdgeRows) -> pa.RecordBatch:
    data = edges.windows.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WINDOW_BYTES]
    ends = np.append(0, np.cumsum(edges.count)) * _WINDOW_BYTES
    windows = pa.Array.from_buffers(pa.binary(), len(edges.key), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([pa.array(edges.key.view(np.int64)), pa.array(edges.doc), pa.array(edges.text), pa.array(edges.start), windows], names=["key", "doc_id", "text_id", "start", "windows"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each row and all windows."""
    values = column.to_pylist()
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(-1, _WINDOW_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :_WINDOW_BYTES] = raw
    return np.array([len(v) // _WINDOW_BYTES for v in values], np.int64), wide.view("<u8").ravel()


def _paths(place: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    """Repeated edges, as rows (doc_id, text_id, start) in order, and their sources alike, as runs with
    one source and diagonal."""
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place, axis=0) != (0, 0, 1)).any(axis=1) | (np.diff(source, axis=0) != (0, 0, 1)).any(axis=1)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(place)))
    columns = [*place[heads].T, sizes, *source[heads].T]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds, strict=True)), pa.array(np.zeros(len(heads), bool))], names=PATH)


def _repeated(batches):
    """From rows sorted by key and document, the edges with a smaller document and their first place.

    Of the last key of a batch only the first place of each window is carried on.
    """
    held = np.empty(0, np.uint64), np.empty((0, 4), np.int64)
    for batch in batches:
        count, window = _unpacked(batch.column(4))
        if not len(window):
            continue
        row = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        # key, document, text, start
        place = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)[row]
        place[:, 3] += offset
        old = len(held[0])
        window, place = np.concatenate([held[0], window]), np.concatenate([held[1], place])
        order = np.lexsort((place[:, 3], place[:, 2], place[:, 1], window, place[:, 0]))
        new = np.append(True, (np.diff(place[order, 0]) != 0) | (window[order][1:] != window[order][:-1]))
        heads = np.flatnonzero(new)
        first = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
        source = np.empty_like(first)
        source[order] = first
        hit = np.flatnonzero(place[source, 1] < place[:, 1])
        hit = hit[hit >= old]
        if len(hit):
            hit = hit[np.lexsort((place[hit, 3], place[hit, 2], place[hit, 1]))]
            yield _paths(place[hit, 1:], place[source[hit], 1:])
        last = order[heads][place[order[heads], 0] == place[-1, 0]]
        held = window[last], place[last]


def _packed_edges(docs: DataFrame, size: int, minimizer: int, chosen) -> DataFrame:
    """The edge rows that ``chosen`` takes by their keys, as EDGES."""

    def run(batches):
        for edges in _edge_blocks(batches, size, minimizer):
            made = _packed(edges.chosen(chosen(edges.key)))
            if made.num_rows:
                yield made

    return _texts(docs).mapInArrow(run, EDGES)


def _single(size: int):
    """Maps packed rows to one row for each edge; returns to it within ``size`` words are one path.

    Such windows overlap or touch, so the words of the path are those of the windows.
    """

    def run(batches):
        for batch in batches:
            count, window = _unpacked(batch.column(4))
            row = np.repeat(np.arange(len(count)), count)
            offset = (np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            order = np.lexsort((offset, window, row))
            row, window, offset = row[order], window[order], offset[order]
            new = np.ones(len(row), bool)
            new[1:] = (np.diff(row) != 0) | (window[1:] != window[:-1]) | (np.diff(offset) > size)
            heads = np.flatnonzero(new)
            lasts = np.append(heads[1:], len(row)) - 1
            own = [batch.column(i).to_numpy()[row[heads]] for i in range(4)]
            columns = [own[0], window[heads].view(np.int64), own[1], own[2], own[3] + offset[heads], offset[lasts] - offset[heads] + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "edge", "doc_id", "text_id", "start", "n"])

    return run


def _with_first(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their smallest (doc_id, text_id, start) under the same key columns."""
    return rows.join(rows.groupBy(*by).agg(F.min(F.struct("doc_id", "text_id", "start")).alias("first")), by)


def _hot_repeats(rows: DataFrame, space: Workspace, size: int) -> DataFrame:
    """Repeated edges of frequent keys, without gathering a key.

    Copies have equal runs of windows, so whole runs are looked up first; only the runs that no
    smaller document has are taken apart into edges.
    """
    runs = space.save(rows.withColumn("print", F.xxhash64("windows")), "hot-runs")
    led = space.save(_with_first(runs, ["key", "print"]), "hot-led", release=True)
    again = F.col("first.doc_id") < F.col("doc_id")
    source = [F.col(f"first.{c}").alias(n) for c, n in (("doc_id", "source_doc"), ("text_id", "source_text"), ("start", "source_start"))]
    copied = led.where(again).withColumn("n", (F.octet_length("windows") / _WINDOW_BYTES).cast("int")).select("doc_id", "text_id", "start", "n", *source, F.lit(False).alias("looped"))
    single = led.where(~again).select("key", "doc_id", "text_id", "start", "windows").mapInArrow(_single(size), "key bigint, edge bigint, doc_id bigint, text_id bigint, start int, n int")
    edges = _with_first(space.save(single, "hot-edges"), ["key", "edge"])
    # an edge that its own text runs through again and again is verified at its first place
    return copied.unionByName(edges.where(again).select("doc_id", "text_id", "start", "n", *source, (F.col("n") > 1).alias("looped")))


def repeated_edges(docs: DataFrame, space: Workspace, size: int = SIZE, minimizer: int = MINIMIZER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs of repeated edges (PLACES); n counts edges."""
    hot = hot_keys(docs, size, minimizer, hot_rows)
    cold = _packed_edges(docs, size, minimizer, lambda keys: ~_hot_mask(keys, hot))
    found = cold.repartition("key").sortWithinPartitions("key", "doc_id", "text_id", "start").mapInArrow(_repeated, PLACES)
    if not len(hot):
        return found
    return found.unionByName(_hot_repeats(_packed_edges(docs, size, minimizer, lambda keys: _hot_mask(keys, hot)), space, size))


def compacted(edges: DataFrame) -> DataFrame:
    """Nonbranching paths: runs that continue each other with the same source and diagonal."""
    line = ["doc_id", "text_id", "source_doc", "source_text", "diagonal"]
    along = Window.partitionBy(*line).orderBy("start")
    broken = F.coalesce(F.lag(F.col("start") + F.col("n")).over(along) != F.col("start"), F.lit(True))
    straight = edges.where(~F.col("looped")).withColumn("diagonal", F.col("start") - F.col("source_start"))
    numbered = straight.withColumn("broken", broken.cast("int")).withColumn("path", F.sum("broken").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    paths = numbered.groupBy(*line, "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("source_start").alias("source_start"), F.lit(False).alias("looped"))
    return paths.select(*PATH).unionByName(edges.where("looped").select(*PATH))


SPANS = "array<struct<start:int,n:int,source_doc:bigint,source_text:bigint,source_start:int>>"
DIGESTS = "source_doc bigint, source_text bigint, source_start int, n int, digest binary"


def span_digests(docs: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """(source_doc, source_text, source_start, n words, digest): of every path the SHA-256 of its own
    words, and of every source place that of its words."""
    words = F.when(F.col("looped"), F.lit(size)).otherwise(F.col("n") + size - 1).cast("int").alias("n")
    asked = paths.select("doc_id", "text_id", "start", words, "source_doc", "source_text", "source_start")
    sources = asked.select("source_doc", "source_text", "source_start", "n").distinct()
    own = sources.select(F.col("source_doc").alias("doc_id"), F.col("source_text").alias("text_id"), F.col("source_start").alias("start"), "n", "source_doc", "source_text", "source_start")
    span = F.struct("start", "n", "source_doc", "source_text", "source_start")
    per_text = asked.unionByName(own).groupBy(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text")).agg(F.collect_list(span).alias("spans"))
    texts = _texts(docs)
    held = texts.join(per_text, (texts["doc_id"] == F.col("of")) & (texts["text_id"] == F.col("of_text"))).select("text", "spans")

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = space_words(text)
                rows += [(s["source_doc"], s["source_text"], s["source_start"], s["n"], hashlib.sha256(b" ".join(words[s["start"] : s["start"] + s["n"]])).digest()) for s in spans]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["source_doc", "source_text", "source_start", "n", "digest"])

    return held.mapInArrow(run, DIGESTS)


def verified(docs: DataFrame, paths: DataFrame, space: Workspace, size: int) -> DataFrame:
    """The paths whose words are those at their source's place; many copies of a place count once."""
    place = ["source_doc", "source_text", "source_start", "n"]
    differing = span_digests(docs, paths, size).groupBy(*place).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    differing = space.save(differing.select(*place), "differing", release=True)
    if differing.limit(1).count() == 0:
        return paths
    words = F.when(F.col("looped"), F.lit(size)).otherwise(F.col("n") + size - 1)
    bad = differing.select(F.struct(F.col("source_doc"), F.col("source_text"), F.col("source_start"), F.col("n").cast("int").alias("n")).alias("bad"))
    return paths.join(bad, F.struct(F.col("source_doc"), F.col("source_text"), F.col("source_start"), words.cast("int").alias("n")) == F.col("bad"), "left_anti")


KEPT = "n_words bigint, n_removed bigint, kept string, kept_sha256 string, n_paths bigint, longest_path bigint"


def remove_repeated(docs: DataFrame, name: str, size: int = SIZE, with_text: bool = True, keep: list[str] | None = None, **how: int) -> DataFrame:
    """``docs`` with a struct column ``name``: what is left of each text without repeated paths."""
    columns = docs.columns if keep is None else keep
    space = Workspace(docs.sparkSession)
    found = space.save(compacted(space.save(repeated_edges(docs, space, size, **how), "edges", release=True)), "paths", release=True)
    space.drop("edges", "hot-runs", "hot-led", "hot-edges")
    paths = verified(docs, found, space, size)
    spans = fresh_name(docs, "spans")
    by_doc = paths.groupBy(F.col("doc_id").alias(f"{spans}_id"), F.col("text_id").alias(f"{spans}_text")).agg(F.collect_list(F.struct("start", (F.col("n") + size - 1).alias("n"))).alias(spans))
    same = (docs["doc_id"].cast("bigint") == by_doc[f"{spans}_id"]) & (_text_id(docs["text"]) == by_doc[f"{spans}_text"])
    joined = docs.join(by_doc, same, "left").drop(f"{spans}_id", f"{spans}_text")
    # spans cross next to the text: eight bytes of count, then start and length of each
    raw = F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["n"])), ","), F.lit(""))
    both = joined.withColumn(spans, F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.concat(raw, F.lit("\n"), F.col("text").cast("string"))))

    def compute(texts):
        for fed in texts:
            listed, _, text = (fed or b"\n").partition(b"\n")
            words = space_words(text)
            mark = np.zeros(len(words) + 1, np.int64)
            lengths = []
            for pair in listed.split(b",") if listed else ():
                start, n = map(int, pair.split(b":"))
                mark[start] += 1
                mark[start + n] -= 1
                lengths.append(n)
            gone = np.cumsum(mark[:-1]) > 0
            left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if lengths else b" ".join(words)
            yield len(words), int(gone.sum()), left.decode() if with_text else None, hashlib.sha256(left).hexdigest(), len(lengths), max(lengths, default=0)

    return with_struct(both, name, KEPT, compute, text=spans, keep=columns)
