"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down the tree domain > language > source. At every node it is shared among
the children in proportion to their weights, up to what a child's subtree can give (its tokens
times ``max_epochs``); what a child can't give goes to its siblings first, and only what a whole
family can't give goes to the family's siblings. Each leaf then takes whole epochs of its
documents and, of one more epoch, the prefix in a seeded order that fits its budget.

Shares are exact integers: children stand in order of capacity to weight, and running sums tell
which are exhausted; the rest is floor-divided among the others by weight. A leaf of any size is
ordered in about sqrt(n) hash buckets: sums of buckets place every bucket, and running sums only
form within one, so that a leaf with a third of all rows is not sorted by one task.

Defined results: null domain, language or source is the child ``unknown``; a null doc_id is
ordered as the text ``null``; null and empty texts have no tokens and are taken whenever their
turn comes; repeated rows are documents of their own; an empty table gives an empty result.
Weights times tokens must stay under 2**63.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.llm.common import Workspace

LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level (1 where not named), epochs at most, and the order's seed.

    budget: tokens wanted; None for as many as the documents have.
    """

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    max_epochs: int = 4
    seed: int = 17
    budget: int | None = None


#: The registered mix: four domains at 4:3:2:1, English at five times Spanish.
TARGET = Mix({"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}})


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """One of four domains of a source name, by the first digit of its MD5."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for name, weight in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("bigint")


def shared_out(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """``nodes`` (family, name, capacity, weight, offered: the family's budget) with ``budget``."""
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.select(
        "*",
        F.sum("weight").over(by).alias("all_weight"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("capacity_before"),
    )
    full = F.col("capacity") * (F.col("all_weight") - F.col("weight_before")) <= (F.col("offered") - F.col("capacity_before")) * F.col("weight")
    marked = ranked.withColumn("full", full)
    used = marked.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0)).alias("given"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(by), F.lit(0)).alias("weight_given"),
    )
    rest = F.expr("((offered - given) * weight) div (all_weight - weight_given)")
    return used.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(rest)).drop("all_weight", "weight_before", "capacity_before", "full", "given", "weight_given", "offered")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, language, source, tokens, documents) with the budget of each."""
    sized = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    total = sized.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    parent = total.select(F.least(F.col("capacity"), F.lit(mix.budget) if mix.budget is not None else F.col("tokens")).alias("offered"))
    path: list[str] = []
    for level in LEVELS:
        nodes = sized.groupBy(*path, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, mix))
        offered = nodes.join(parent, path) if path else nodes.crossJoin(F.broadcast(parent))  # one row at the root
        shared = shared_out(offered, path, level)
        path = [*path, level]
        parent = shared.select(*path, F.col("budget").alias("offered"))
    return leaves.join(parent.withColumnRenamed("offered", "budget"), list(LEVELS))


def mixture(docs: DataFrame, mix: Mix = TARGET, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, epochs) of the documents taken at least once."""
    space = Workspace(docs.sparkSession)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    source = name(docs["source"])
    rows = space.save(
        docs.select(
            docs["doc_id"].cast("bigint").alias("doc_id"), name(domain if domain is not None else domain_of(source)).alias("domain"), name(docs["lang"]).alias("language"), source.alias("source"),
            token_count(docs["text"].cast("string")).alias("n_tokens"),
        ),
        "rows",
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = leaf_budgets(leaves, mix).select(
        *LEVELS,
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
        F.ceil(F.sqrt(F.col("documents").cast("double"))).alias("n_buckets"),
    )
    budgets = space.save(plan, "budgets")
    place = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    ordered = rows.join(budgets, list(LEVELS)).withColumn("place", place)
    head = F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint")
    bucketed = ordered.withColumn("bucket", F.shiftright(head * F.col("n_buckets"), 32))
    leaf = list(LEVELS)
    sums = bucketed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"at_{c}") for c in (*leaf, "bucket")], F.coalesce(F.sum("held").over(before), F.lit(0)).alias("skipped"))
    joined = bucketed.join(offsets, [F.col(c) == F.col(f"at_{c}") for c in (*leaf, "bucket")])
    within = Window.partitionBy(*leaf, "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    reached = joined.withColumn("reach", F.col("skipped") + F.sum("n_tokens").over(within))
    epochs = F.col("whole") + F.when((F.col("reach") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    return reached.select("doc_id", *leaf, "n_tokens", epochs.cast("bigint").alias("epochs")).where("epochs > 0")
