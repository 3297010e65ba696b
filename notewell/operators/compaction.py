"""Conversations cut to a budget of characters: their beginning, their end, and the person's words between.

A conversation within the budget stays whole. Of a longer one stay the first two messages (cut), the
last ones whole as far as their share reaches (the last one cut if it alone is over it), and of the user's messages
between an even sample (cut). If that is still over the budget, kept messages go from the middle
outwards; what is left of the first two is cut at the budget.

Messages stay rows. Places and sums run within slices of ``SLICE`` turns and carry over by one row a
slice, so a conversation that holds a third of all messages is dealt over many tasks, and no row or
group ever holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.sources.scratch import Scratch

# Shares and lengths of the parts, what a heading and the notes on what is left out take.
FIRST, USER, LEAST_TAIL, TAIL_SHARE = 4_000, 600, 500, 0.45
HEADING, RESERVE, PER_CUT = 16, 600, 40
CUT_MARK = "\n[… message cut …]"
SLICE = 512


def running(rows: DataFrame, key: str, order: list[str], turn: str, **values: Column) -> DataFrame:
    """``rows`` with ``place`` (from 0), ``n``, and for each value its running sum ``<name>_to`` and its ``<name>_all``.

    Sums within a slice of turns and offsets of slices: two small windows for one large one. ``order``
    must begin with ``turn``, whose nulls come first.
    """
    slices = rows.withColumns({"_slice": F.coalesce(F.floor(F.col(turn) / SLICE), F.lit(-1)), "_one": F.lit(1), **{f"_{k}": v for k, v in values.items()}})
    names = ["one", *values]
    inside = Window.partitionBy(key, "_slice").orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = slices.withColumns({f"_{k}_in": F.sum(f"_{k}").over(inside) for k in names})
    totals = slices.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_part")).agg(*[F.sum(f"_{k}").alias(f"_{k}_sum") for k in names])
    along, whole = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key")
    placed = totals.select("_key", "_part", *[F.coalesce(F.sum(f"_{k}_sum").over(along), F.lit(0)).alias(f"_{k}_before") for k in names], *[F.sum(f"_{k}_sum").over(whole).alias(f"_{k}_total") for k in names])
    joined = local.join(placed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_part")))
    told = {"place": F.col("_one_in") + F.col("_one_before") - 1, "n": F.col("_one_total")}
    for k in values:
        told |= {f"{k}_to": F.col(f"_{k}_in") + F.col(f"_{k}_before"), f"{k}_all": F.col(f"_{k}_total")}
    return joined.select(*rows.columns, *[v.alias(k) for k, v in told.items()])


def _cut(text: Column, limit) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit))), F.lit(CUT_MARK)))


def compacted(messages: DataFrame, budget: int, first: int = FIRST, user: int = USER) -> DataFrame:
    """(conv_id, turn, place, n, role, part, text) of the messages that stay, of messages (conv_id, turn, role, text).

    Parts: whole (a conversation within the budget), first, tail, middle. A null text is empty; of rows with one turn the
    role, then the text decide the order; a null conversation is one of its own.
    """
    room = budget - RESERVE
    tail_room = int(room * TAIL_SHARE)
    held = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    placed = running(held, "conv_id", ["turn", "role", "text"], "turn", chars=size, taken=size + HEADING)
    after = F.col("chars_all") - F.col("chars_to") + size  # from this message to the end
    last = F.col("place") == F.col("n") - 1
    part = (
        F.when(F.col("taken_all") <= budget, "whole").when(F.col("place") < 2, "first").when(after <= tail_room, "tail")
        .when(last, "cut tail").when(F.col("role") == "user", "middle").otherwise("left out")
    )
    text = F.when(F.col("part") == "first", _cut(F.col("text"), first)).when(F.col("part") == "cut tail", _cut(F.col("text"), F.lit(max(LEAST_TAIL, tail_room)))).when(F.col("part") == "middle", _cut(F.col("text"), user)).otherwise(F.col("text"))
    space = Scratch(messages.sparkSession)  # both tables are read several times
    judged = placed.withColumn("part", part).where("part <> 'left out'").withColumn("text", text).select("conv_id", "turn", "place", "n", "role", "part", "text")
    judged = space.save(judged, "judged")

    # the sample of the middle fits what first and tail leave
    used = judged.groupBy(F.col("conv_id").alias("of")).agg(F.coalesce(F.sum(F.when(F.col("part").isin("first", "tail", "cut tail"), F.length("text"))), F.lit(0)).alias("used"))
    asked = running(judged.where("part = 'middle'").withColumnsRenamed({"place": "at", "n": "of_all"}), "conv_id", ["turn", "at"], "turn")
    met = asked.join(used, F.col("conv_id").eqNullSafe(F.col("of")))
    left, per = F.lit(room) - F.col("used"), user + PER_CUT
    step = F.greatest(F.lit(1), F.ceil(F.col("n") * per / left))
    sampled = met.where((left > per) & (F.col("place") % step == 0)).select("conv_id", "turn", F.col("at").alias("place"), F.col("of_all").alias("n"), "role", "part", "text")
    kept = space.save(judged.where("part <> 'middle'").unionByName(sampled), "kept")

    # what is over the budget goes from the middle of the kept ones outwards; the first two and the last stay
    victim = (F.col("part") != "whole") & (F.col("place") > 1) & (F.col("place") < F.col("n") - 1)
    sizes = kept.groupBy(F.col("conv_id").alias("of")).agg(F.sum(F.length("text") + HEADING).alias("total"), F.count(F.when(victim, 1)).alias("victims"), F.max(F.col("part") != "whole").alias("cut"))
    over = sizes.where(F.col("cut") & (F.col("total") > room))
    tight = running(kept.join(over, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").where(victim).withColumnsRenamed({"place": "at", "n": "of_all"}), "conv_id", ["turn", "at"], "turn")
    off = F.col("place") - F.floor(F.col("n") / 2)
    sign = F.when(F.col("n") % 2 == 1, F.when(off > 0, 0).otherwise(1)).otherwise(F.when(off < 0, 0).otherwise(1))
    turns = tight.withColumn("going", F.abs(off) * 2 + F.when(off == 0, 0).otherwise(sign)).select("conv_id", F.col("going").alias("turn"), "at", (F.length("text") + HEADING).alias("size"))
    gone = running(turns, "conv_id", ["turn", "at"], "turn", size=F.col("size")).join(over, F.col("conv_id").eqNullSafe(F.col("of")))
    gone = gone.where(F.col("size_to") - F.col("size") < F.col("total") - room).select(F.col("conv_id").alias("gone_conv"), F.col("at").alias("gone_place"))
    fitting = kept.join(gone, F.col("conv_id").eqNullSafe(F.col("gone_conv")) & (F.col("place") == F.col("gone_place")), "left_anti")
    ends = running(fitting.withColumnsRenamed({"place": "at", "n": "of_all"}), "conv_id", ["turn", "at"], "turn", taken=F.length("text") + HEADING)
    begin = F.col("taken_to") - F.length("text")
    within = F.when(F.col("part") == "whole", F.col("text")).otherwise(F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - begin)))
    return ends.select("conv_id", "turn", F.col("at").alias("place"), F.col("of_all").alias("n"), "role", F.when(F.col("part") == "cut tail", "tail").otherwise(F.col("part")).alias("part"), within.alias("text"))
