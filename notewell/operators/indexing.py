"""The index as tables that a batch of changed notes maintains by retraction.

Rows by path: ``fragments``, ``terms`` (term counts of fragments) and ``edges`` (wikilinks). Sums:
``frequency`` (fragments a term is in), ``totals`` (fragments and their terms) and ``targets`` (notes
that link to a name). A batch takes back what its notes gave to the sums before, as negative rows,
and adds what they give now; no row of another note is read for it, and none is written.

A note without content has no rows; a path given twice in a batch must have one row there
(``streaming.maintenance.coalesced`` sees to that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.operators import bm25
from notewell.operators.fragments import fragments
from notewell.operators.graph import wikilinks
from notewell.sources.generations import Generations

#: Tables that add up, with their keys.
SUMS = {"frequency": ["term"], "totals": [], "targets": ["target"]}
#: Deltas that a reader should meet at most before they are compacted.
MAX_DELTAS = 20


def edges(notes: DataFrame) -> DataFrame:
    """(path, target) of the distinct wikilinks of notes (path, content)."""
    return wikilinks(notes).select(F.col("source").alias("path"), "target").distinct()


def sums(terms: DataFrame, links: DataFrame, sign: int = 1) -> dict[str, DataFrame]:
    """What rows of ``terms`` and ``edges`` give to the sums."""
    one = F.lit(sign).cast("bigint")
    return {
        "frequency": terms.where("term is not null").groupBy("term").agg(F.sum(one).alias("df")),
        "totals": terms.where("head").agg(F.coalesce(F.sum(one), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("length") * one), F.lit(0)).alias("length")),
        "targets": links.groupBy("target").agg(F.sum(one).alias("n_sources")),
    }


def build(store: Generations, notes: DataFrame, now_ns: int, streams: dict[str, int] | None = None, markdown: bool = True) -> int:
    """Publish a whole index of notes (path, content); ``markdown`` as in ``fragments``, the same for all batches."""
    number = store.begin(now_ns)
    made = {"fragments": fragments(notes, markdown), "edges": edges(notes)}
    store.write(number, made)
    store.write(number, {"terms": bm25.term_counts(_written(store, number, "fragments"))})
    rows = {name: _written(store, number, name) for name in ("fragments", "terms", "edges")}
    store.write(number, sums(rows["terms"], rows["edges"]))
    held = store.manifest().get("streams", {})
    return store._publish(number, base=number, tables=sorted([*rows, *SUMS]), sums=SUMS, streams=held | (streams or {}))


def _written(store: Generations, number: int, name: str) -> DataFrame:
    return store.spark.read.parquet(store.table_path(number, name))


def apply(store: Generations, changed: DataFrame, streams: dict[str, int] | None = None, max_deltas: int = MAX_DELTAS, markdown: bool = True) -> int:
    """Publish the index after a batch of changes (path, content, deleted), each path once.

    All tables of the index change together. Every ``max_deltas`` batches the index is made whole again.
    """
    held = store.manifest()
    number = store.begin()
    store.write(number, {"touched": changed.select("path")})
    touched = _written(store, number, "touched")
    live = changed.where(~F.col("deleted")).select("path", "content")
    store.write(number, {"fragments": fragments(live, markdown)})
    if "terms" in held["tables"]:
        store.write(number, {"edges": edges(live), "terms": bm25.term_counts(_written(store, number, "fragments"))})
        new = {name: _written(store, number, name) for name in ("terms", "edges")}
        old = {name: store.read(name, touched) for name in ("terms", "edges")}
        given, taken = sums(new["terms"], new["edges"]), sums(old["terms"], old["edges"], -1)
        for name, keys in SUMS.items():
            numbers = [c for c in given[name].columns if c not in keys]
            both = given[name].unionByName(taken[name]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers])
            store.write(number, {name: both.where(" OR ".join(f"{c} <> 0" for c in numbers))})
    store.append(number, {}, streams)
    return store.compact() if len(held["deltas"]) + 1 >= max_deltas else number
