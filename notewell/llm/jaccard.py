"""Exact Jaccard metric-space join of documents on their word shingles.

Jaccard distance d is a metric, and two documents link when d <= r (r = 0.2). Exact copies are
one point. Documents without a common shingle are at distance 1, which no pivot can order, so the
space first falls apart into regions: every point names the keys of its neighbourhood, its first
n - ceil((1-r) n) + 1 shingles in one global order (two points within r share a key), the points
around a key elect a pivot, the most central of them, and all keys with one pivot form a region.

A region of at most ``leaf`` points is joined by windows of the distance to its pivot: points
whose distances differ by more than r can't link. A larger one is divided: its points are measured
against several pivots of its own, each goes to the Voronoi cell of its nearest pivot, at distance
d, and boundary points also to every cell whose pivot is within d + 2r of them. By the triangle
inequality two points within r meet in the nearest cell of either. Cells are divided again until
they fit. Points within r of a pivot are connected through it: the largest connected group of a
cell needs no replicas, since the others come to it, and a cell of connected points is done. A cell that its pivots can't divide (its points lie close together) is cut
along the distance to its pivot into bins of r/4; only bins within r of each other meet, in blocks,
and only for the points that the cell's largest connected group doesn't hold.
Every link between different texts is kept as a path of links.

The global order puts frequent shingles last (a counting pass, in which tasks report what is
frequent among their rows) and otherwise long shingles, which are rarer, first. Any order gives
the same links; this one keeps common passages and chance repeats of short words from electing
regions of their own.

Defined results: null and empty texts have no shingles and link with nothing; texts of fewer than
``size`` words have one shingle; rows with a null doc_id take no part and get no component; rows
that repeat a doc_id are one document in the graph; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace, blocks
from notewell.llm.components import components
from notewell.llm.grams import Tally, gram_hashes, word_hashes

SIZE = 5
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 80
LEAF = 256
#: One key in so many shingles is asked for beyond the first shared one.
SHARED_PART = 20
HOT_ROWS = 64
REPORTED = 4
MAX_HOT = 500_000
#: Pivots that a cell is divided by at once, and the share of it that its largest new cell may have.
MAX_PIVOTS = 32
DIVIDED = 0.8
#: How many times its points the cells of a divided one may hold together.
SPREAD = 4
#: Bins of the distance axis in one radius.
BINS = 4
#: Copies of one text that a task takes, and how many texts with more are told apart.
HOT_COPIES = 500
MAX_HOT_PRINTS = 10_000

SETS = "doc_id bigint, print binary, n bigint, keys array<bigint>"


def shingle_sets(texts: list[bytes | None], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ascending distinct shingle hashes of each text, with A-Z lower-cased, and their bytes of words."""
    words, bounds, lengths = word_hashes([t.lower() if t else t for t in texts])
    grams = gram_hashes(words, size)
    total = np.append(0, np.cumsum(lengths))
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= size:
            row, first = np.unique(grams[low : high - size + 1], return_index=True)
            out.append((row, total[low + first + size] - total[low + first]))
        else:
            out.append((gram_hashes(words[low:high], high - low) if high > low else np.empty(0, np.uint64), total[high : high + (high > low)] - total[low]))
    return out


def least_shared(n: int) -> int:
    """Keys that a point of n shingles shares at least with every point it links with of its size."""
    return 1 + n // SHARED_PART


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """First shingles such that two linking points share ``least_shared`` of the smaller one."""
    return min(n, n - -(-similar * n // 100) + least_shared(n))


def _set_blocks(batches, size: int):
    """Ids and shingle sets of the blocks of Arrow batches of (doc_id, text)."""
    for batch in batches:
        ids, at = batch.column(0).to_pylist(), 0
        for block in blocks(batch.column(1).to_pylist()):
            yield ids[at : at + len(block)], shingle_sets(block, size)
            at += len(block)


def _by_text(docs: DataFrame, schema: str, run) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary")).mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame, size: int, hot_rows: int, reported: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in the most documents, ascending, and in how many."""

    def count(batches):
        tally = Tally()
        for _, sets in _set_blocks(batches, size):
            tally.add(np.concatenate([row for row, _ in sets]))
        keys, n = tally.at_least(reported)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    found = _by_text(docs, "key bigint, n bigint", count).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_rows)
    rows = found.orderBy(F.desc("n"), "key").limit(MAX_HOT).toPandas()
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(np.int64)[order]


def _neighbourhoods(docs: DataFrame, size: int, similar: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    hot, counts = frequent

    def first(row: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not len(row):
            return row.view(np.int64)
        rank = np.zeros(len(row), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, row), len(hot) - 1)
            rank = np.where(hot[at] == row, counts[at], 0)
        return row[np.lexsort((row, -length, rank))[: prefix_length(len(row), similar)]].view(np.int64)

    def run(batches):
        for ids, sets in _set_blocks(batches, size):
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s, _ in sets]
            columns = [pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array([first(*s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print", "n", "keys"])

    return _by_text(docs, SETS, run)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def joined_region(ids, sets: list[np.ndarray], groups, pivot: int | None, similar: int, away: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever the points' links connect, between points of different groups.

    groups: points with one non-negative group number are connected already. away: the points'
    distances to one pivot; with ``pivot`` they are measured here. Only windows of them are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    forest, seen, links = _Forest(n), {}, []
    for k, group in enumerate(groups):
        if group >= 0:
            forest.join(seen.setdefault(group, k), k)

    def shared(x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of point x with some others."""
        row = sets[x]
        if len(others) == n:
            values, whose = flat, owner
        else:
            values = np.concatenate([sets[y] for y in others]) if len(others) else np.empty(0, np.uint64)
            whose = np.repeat(np.arange(len(others)), sizes[others])
        at = np.minimum(np.searchsorted(row, values), len(row) - 1)
        return np.bincount(whose[row[at] == values], minlength=len(others))

    def connect(x: int, others: np.ndarray) -> None:
        common = shared(x, others)
        hit = others[100 * common >= similar * (sizes[x] + sizes[others] - common)]
        for y in hit.tolist():
            if y != x and forest.join(x, y):
                links.append((int(ids[x]), int(ids[y])))

    if pivot is not None:
        common = shared(pivot, np.arange(n))
        away = 1 - common / np.maximum(1, sizes + sizes[pivot] - common)
        connect(pivot, np.arange(n))
    elif away is None:
        away = np.zeros(n)
    reach = radius(similar) + 1e-9
    order = np.argsort(away, kind="stable")
    roots = np.array([forest.root(k) for k in range(n)])
    if n and len(set(roots.tolist())) == 1:
        return links
    # points outside the largest group are compared with their window; what is inside is connected
    main = np.bincount(roots).argmax() if n else -1
    ranked = away[order]
    for x in order.tolist():
        if roots[x] == main:
            continue
        low, high = np.searchsorted(ranked, away[x] - reach, "left"), np.searchsorted(ranked, away[x] + reach, "right")
        others = order[low:high]
        near = (100 * np.minimum(sizes[others], sizes[x]) >= similar * np.maximum(sizes[others], sizes[x])) & (others != x)
        here = forest.root(x)
        others = others[near]
        others = others[[forest.root(y) != here for y in others.tolist()]] if len(others) else others
        if len(others):
            connect(x, others)
    return links


def radius(similar: int) -> float:
    """The distance up to which points link."""
    return 1 - similar / 100


PLACED = ("task", "doc_id", "is_pivot", "grp", "away", "measure")


def _placed_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (PLACED) with the text of each point.

    Texts cross by doc_id in a sort-merge join at every size, so that memory doesn't depend on how
    many places there are.
    """
    text = docs.select(F.col("doc_id").alias("id"), F.col("text")).hint("merge")
    return places.join(text, F.col("doc_id") == F.col("id")).select(*PLACED, F.col("text").cast("binary").alias("text"))


FOUND = "task string, doc_id bigint, pivots array<bigint>, away array<double>, axis double, linked array<bigint>, text binary"


def cells_of(away: np.ndarray, similar: int) -> np.ndarray:
    """Mask of (point, pivot): the nearest pivot's cell, and those of pivots within 2r beyond that distance."""
    return away <= away.min(axis=1, keepdims=True) + 2 * radius(similar) + 1e-9


def _joined(held: list[dict], sets: list[np.ndarray], similar: int) -> list[tuple]:
    """FOUND rows of a block that is joined: each point's links, and nothing else."""
    at = [k for k, r in enumerate(held) if r["is_pivot"]]
    links = joined_region([r["doc_id"] for r in held], sets, [r["grp"] for r in held], at[0] if at else None, similar, np.array([r["away"] for r in held], float))
    return [(held[0]["task"], a, None, None, None, [b], None) for a, b in links]


def _measured(held: list[dict], sets: list[np.ndarray], similar: int) -> list[tuple]:
    """FOUND rows of a block that is measured, one for every point that isn't there as a pivot: the
    cells it enters with their pivots' distances, nearest first, the distance to the first pivot, and
    the pivots it links with; and its text, for the passes to come."""
    sizes = np.array([len(s) for s in sets], np.int64)
    pivots = [k for k, r in enumerate(held) if r["is_pivot"]]
    points = [k for k, r in enumerate(held) if not r["is_pivot"]]
    common = np.zeros((len(points), len(pivots)), np.int64)
    flat, owner = np.concatenate([np.empty(0, np.uint64), *(sets[k] for k in points)]), np.repeat(np.arange(len(points)), sizes[points])
    for j, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(sets[p], flat), len(sets[p]) - 1)
        common[:, j] = np.bincount(owner[sets[p][at] == flat], minlength=len(points))
    union = sizes[points][:, None] + sizes[pivots][None, :] - common
    away, close = 1 - common / np.maximum(1, union), 100 * common >= similar * union
    names, enters, rows = np.array([held[k]["doc_id"] for k in pivots], np.int64), cells_of(away, similar), []
    for k, row, mask, near in zip(points, away, enters, close, strict=True):
        nearest = np.flatnonzero(mask)[np.argsort(row[mask], kind="stable")]
        rows.append((held[0]["task"], held[k]["doc_id"], names[nearest], row[nearest], row[0], names[near], held[k]["text"]))
    return rows


def _worked(rows: DataFrame, size: int, similar: int) -> DataFrame:
    """FOUND of (PLACED, text): every task is one bounded block of points, joined or measured."""
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.binary()]

    def work(held: list[dict]) -> pa.RecordBatch:
        sets = [row for row, _ in shingle_sets([r["text"] for r in held], size)]
        found = (_measured if held[0]["measure"] else _joined)(held, sets, similar)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["task", "doc_id", "pivots", "away", "axis", "linked", "text"])

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["task"] != row["task"]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return rows.repartition("task").sortWithinPartitions("task", "doc_id").mapInArrow(run, FOUND)


def region_members(sets: DataFrame, space: Workspace, similar: int = SIMILAR) -> DataFrame:
    """(pivot, doc_id): the regions of all pivots, the pivot itself included.

    Two linking points share at least least_shared keys, whose pivots are among those of either;
    so some pivot holds that many divided by the pivots of a point, and memberships with fewer
    keys (linking points being alike in size) can go.
    """
    points = sets.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("keys", "n"), "doc_id").alias("p"))
    rows = points.select("doc_id", F.col("p.n").alias("n"), F.explode("p.keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("key", "met")
    live = space.save(rows.join(shared, F.col("key") == F.col("met")).select("key", "doc_id", "n", "m"), "live", release=True)
    central = live.groupBy("doc_id").agg((F.sum(F.log2(F.col("m").cast("double"))) / F.max("n")).alias("score")).withColumnRenamed("doc_id", "id")
    scored = live.join(central, F.col("doc_id") == F.col("id")).select("key", "doc_id", F.struct(F.round("score", 6), -F.col("doc_id")).alias("rank"))
    pivots = scored.groupBy(F.col("key").alias("met")).agg(F.max_by("doc_id", "rank").alias("pivot"))
    held = space.save(live.join(pivots, F.col("key") == F.col("met")).groupBy("pivot", "doc_id", "n").agg(F.count("*").alias("held")), "held", release=True)
    spread = held.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("pivots"))
    enough = F.col("held") * F.col("pivots") >= 1 + F.floor(F.col("n") * similar / (100 * SHARED_PART))
    kept = held.join(spread, F.col("doc_id") == F.col("id")).where(enough | (F.col("doc_id") == F.col("pivot")))
    members = space.save(kept.select("pivot", "doc_id"), "members")
    space.drop("live", "held")
    return members


def link_edges(docs: DataFrame, sets: DataFrame, space: Workspace, size: int, similar: int, leaf: int) -> DataFrame:
    """Edges between points that connect exactly what links connect.

    Every pass over the texts joins the cells that fit and measures those that don't.
    """
    members = region_members(sets, space, similar)
    sizes = members.groupBy(F.col("pivot").alias("region")).agg(F.count("*").alias("m")).where("m > 1")
    placed = members.join(sizes, F.col("pivot") == F.col("region")).select(F.col("pivot").cast("string").alias("cell"), "doc_id", (F.col("doc_id") == F.col("pivot")).alias("is_pivot"), "m")
    places = placed.where(F.col("m") <= leaf).select(F.col("cell").alias("task"), "doc_id", "is_pivot", F.lit(-1).cast("bigint").alias("grp"), F.lit(0.0).alias("away"), F.lit(False).alias("measure"))
    open_ = space.save(placed.where(F.col("m") > leaf).select("cell", "doc_id"), "open-0")
    level, edges, between = 0, None, None
    while True:
        left = open_.limit(1).count() > 0
        sized = _sized(open_)
        wanted = places.unionByName(_measuring(sized, level, leaf)) if left else places
        found = space.save(_worked(_placed_texts(docs, wanted), size, similar), f"found-{level}", release=True)
        space.drop(f"points-{level - 1}", f"parents-{level - 1}", f"cells-{level - 1}")
        linked = found.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b"), F.col("pivots").isNotNull().alias("measured")).where("a <> b")
        edges = linked.select("a", "b") if edges is None else edges.unionByName(linked.select("a", "b"))
        if not left:
            return edges
        # of the first pass only the cells that are still open need their groups
        known = linked.where("measured").select("a", "b") if level == 0 else linked.select("a", "b")
        between = known if between is None else between.unionByName(known)
        if level == 0:
            # only texts of open cells are shuffled again; two texts under one doc_id both stay
            open_texts = found.where(F.col("pivots").isNotNull()).groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
            docs = open_texts.select("doc_id", F.explode("texts").alias("text"))
        places, open_ = _divided(found.where(F.col("pivots").isNotNull()), sized, between, space, level, similar, leaf)
        level += 1


def _sized(cells: DataFrame) -> DataFrame:
    """(cell, doc_id, m): cells with their sizes."""
    sizes = cells.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("m"))
    return cells.join(sizes, F.col("cell") == F.col("of")).select("cell", "doc_id", "m")


def _measuring(sized: DataFrame, level: int, leaf: int) -> DataFrame:
    """Places (PLACED) that measure the points of cells, in chunks, against pivots drawn from each."""
    slots = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("m") / leaf) + 1).cast("int")
    slot = F.pmod(F.xxhash64("doc_id", F.lit(level)), slots)
    pivots = sized.groupBy("cell", "m", slot.alias("slot")).agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id", F.lit(-1 - level)), "doc_id")).alias("doc_id"))
    n_chunks = F.ceil(F.col("m") / leaf).cast("int")
    task = lambda chunk: F.concat_ws("/", "cell", chunk)
    own = sized.select(task(F.pmod(F.xxhash64("doc_id"), n_chunks)).alias("task"), "doc_id", F.lit(False).alias("is_pivot"))
    centres = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))).select(task(F.col("chunk")).alias("task"), "doc_id", F.lit(True).alias("is_pivot"))
    return own.unionByName(centres).select("*", F.lit(-1).cast("bigint").alias("grp"), F.lit(0.0).alias("away"), F.lit(True).alias("measure"))


def _divided(measured: DataFrame, sized: DataFrame, between: DataFrame, space: Workspace, level: int, similar: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """One level of recursion: the places that join what fits or is dense, and the cells still open."""
    labels = components(between, space, f"level-{level}")
    points = measured.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        F.substring_index("task", "/", 1).alias("of"), "doc_id", F.coalesce("label", "doc_id").alias("grp"), "axis", F.arrays_zip("pivots", "away").alias("enters")
    )
    points = space.save(points, f"points-{level}")
    counts = points.groupBy("of", "grp").agg(F.count("*").alias("m"))
    main = counts.groupBy(F.col("of").alias("parent")).agg(F.max_by("grp", F.struct("m", -F.col("grp"))).alias("main"))
    exploded = points.join(main, F.col("of") == F.col("parent")).select("of", "doc_id", "grp", "main", F.posexplode("enters").alias("nth", "e"))
    # points of the largest connected group stay in their nearest cell, which the others enter
    entered = exploded.where((F.col("nth") == 0) | (F.col("grp") != F.col("main"))).select(F.concat_ws(":", "of", "e.pivots").alias("cell"), "of", "doc_id", "grp", F.col("e.away").alias("away"))
    unfinished = entered.groupBy("cell", "of").agg(F.count("*").alias("m"), F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
    whole = sized.select(F.col("cell").alias("parent"), F.col("m").alias("whole")).distinct()
    parents = unfinished.groupBy("of").agg(F.max("m").alias("most"), F.sum("m").alias("all")).join(whole, F.col("of") == F.col("parent"))
    divided = (F.col("most") <= leaf) | ((F.col("most") <= DIVIDED * F.col("whole")) & (F.col("all") <= SPREAD * F.col("whole")))
    parents = space.save(parents.select("parent", divided.alias("divided")), f"parents-{level}")
    kinds = unfinished.join(parents.where("divided"), F.col("of") == F.col("parent")).select(F.col("cell").alias("c"), (F.col("m") <= leaf).alias("fits"))
    cells = space.save(entered.join(kinds, F.col("cell") == F.col("c")).select("cell", "doc_id", "grp", "away", "fits"), f"cells-{level}")
    fitting = cells.where("fits").select(F.col("cell").alias("task"), "doc_id", F.lit(False).alias("is_pivot"), "grp", "away")
    dense = points.join(parents.where("not divided"), F.col("of") == F.col("parent")).select(F.col("of").alias("cell"), "doc_id", "grp", F.col("axis").alias("away"))
    places = fitting.unionByName(_bins(dense, similar, leaf)).withColumn("measure", F.lit(False))
    return places, space.save(cells.where("not fits").select("cell", "doc_id"), f"open-{level + 1}")


def _bins(cells: DataFrame, similar: int, leaf: int) -> DataFrame:
    """Places (PLACED) of cells that pivots don't divide: blocks of bins of the distance axis.

    The cell's largest connected group is its main one; each other point meets the points of all
    bins that its window reaches, in pairs of blocks.
    """
    width = radius(similar) / BINS
    counts = cells.groupBy("cell", "grp").agg(F.count("*").alias("m"))
    main = counts.groupBy(F.col("cell").alias("of")).agg(F.max_by("grp", F.struct("m", -F.col("grp"))).alias("main"))
    side = F.when(F.col("grp") == F.col("main"), "main").otherwise("apart")
    points = cells.join(main, F.col("cell") == F.col("of")).select("cell", "doc_id", "grp", "away", side.alias("side"), F.floor(F.col("away") / width).cast("int").alias("bin"))
    sizes = points.groupBy("cell", "side", "bin").agg(F.count("*").alias("n"))
    one = sizes.where("side = 'apart'").select("cell", F.col("bin").alias("bin1"), F.col("n").alias("n1"))
    two = sizes.select(F.col("cell").alias("cell2"), F.col("side").alias("side2"), F.col("bin").alias("bin2"), F.col("n").alias("n2"))
    reach = F.col("bin2").between(F.col("bin1") - BINS - 1, F.col("bin1") + BINS + 1) & ((F.col("side2") == "main") | (F.col("bin2") >= F.col("bin1")))
    # a few dozen bins a cell, met by cell
    meets = one.join(two, (F.col("cell") == F.col("cell2")) & reach).select("cell", "bin1", "side2", "bin2", F.ceil(F.col("n1") * 2 / leaf).cast("int").alias("of1"), F.ceil(F.col("n2") * 2 / leaf).cast("int").alias("of2"))
    keys = meets.withColumnRenamed("cell", "in_cell")
    block = lambda of: F.pmod(F.xxhash64("doc_id"), of).cast("int")
    itself = (F.col("side2") == "apart") & (F.col("bin1") == F.col("bin2"))
    first = points.where("side = 'apart'").join(keys, (F.col("cell") == F.col("in_cell")) & (F.col("bin") == F.col("bin1"))).withColumn("i", block(F.col("of1"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of2") - 1)))
    second = points.join(keys, (F.col("cell") == F.col("in_cell")) & (F.col("bin") == F.col("bin2")) & (F.col("side") == F.col("side2"))).withColumn("j", block(F.col("of2"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of1") - 1)))
    # a bin with itself: every pair of blocks once, every point of a block once
    placed = first.where(~itself | (F.col("j") >= F.col("i"))).unionByName(second.where(~itself | (F.col("i") < F.col("j"))))
    return placed.select(F.concat_ws(":", "cell", "bin1", "side2", "bin2", "i", "j").alias("task"), "doc_id", F.lit(False).alias("is_pivot"), "grp", "away")


def _with_first(sets: DataFrame, first: DataFrame, counts: DataFrame) -> DataFrame:
    """``sets`` with the point of their print; the prints of the most rows are dealt over several tasks.

    At most MAX_HOT_PRINTS of them are told apart (and broadcast), so no other print has more than
    that share of the rows.
    """
    hot = counts.where(F.col("copies") >= HOT_COPIES).orderBy(F.desc("copies"), "of").limit(MAX_HOT_PRINTS).select(F.col("of").alias("hot"), F.ceil(F.col("copies") / HOT_COPIES).cast("int").alias("parts"))
    dealt = sets.join(F.broadcast(hot), F.col("print") == F.col("hot"), "left").withColumn("part", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int")).drop("hot", "parts")
    spread = first.join(F.broadcast(hot), F.col("of") == F.col("hot"), "left").select("of", "point", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("at"))
    same = (F.col("print") == F.col("of")) & (F.col("part") == F.col("at")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return dealt.join(spread, same, "left").drop("part", "at", "of")


def near_duplicates(docs: DataFrame, size: int = SIZE, similar: int = SIMILAR, leaf: int = LEAF, hot_rows: int = HOT_ROWS, reported: int = REPORTED) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    space = Workspace(docs.sparkSession)
    named = docs.where("doc_id is not null")
    sets = space.save(_neighbourhoods(docs, size, similar, frequent_shingles(named, size, hot_rows, reported)), "sets")
    usable = sets.where("doc_id is not null")
    counts = space.save(usable.where("n > 0").groupBy(F.col("print").alias("of")).agg(F.min("doc_id").alias("point"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    first = counts.select("of", "point")
    # one document under several texts ties their points together
    versions = usable.where("n > 0").groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select(F.col("doc_id").alias("again"))
    ties = usable.where("n > 0").join(versions, F.col("doc_id") == F.col("again")).join(first, F.col("print") == F.col("of"), "left").select(F.col("doc_id").alias("a"), F.coalesce("point", "doc_id").alias("b"))
    edges = link_edges(named, usable, space, size, similar, leaf).unionByName(ties)
    labels = components(edges, space, "links")
    placed = _with_first(sets, first, counts).withColumn("point", F.coalesce("point", "doc_id"))
    found = placed.join(labels, F.col("point") == F.col("node"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "point").alias("component_id"))


def one_of_each(docs: DataFrame, **how: int) -> DataFrame:
    """The documents, with all their columns, that have the smallest doc_id of their component.

    Of rows that repeat a kept doc_id one stays; rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, **how).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    first = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    return first.join(kept, first["doc_id"].cast("bigint") == F.col("kept"), "left_semi").unionByName(docs.where("doc_id is null"))
