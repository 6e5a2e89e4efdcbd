"""Order documents so that every prefix follows target weights per source (proportionate-fair scheduling).

Documents of a source form blocks. Block ``i`` of a source with ``c`` of every ``D`` slots is released at slot
``floor(i * D / c)`` and due by ``ceil((i + 1) * D / c)``. Of the released blocks, the one due earliest takes the
next slot. Block counts then stay within one block of their share at every slot, and the schedule repeats after
``D`` slots, so one period is scheduled and joined to the blocks of all sources.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import without

#: Slots of a period; the scheduled period is a table of so many rows at most.
LONGEST_PERIOD = 10_000
ADDED = ("lane", "block", "slot", "position", "in_mix")


def period(spark, shares: Mapping[str, int], rest: int) -> DataFrame:
    """One period as rows (lane, occurrence, slot, share); lane is the source's place in ``shares``, the rest last."""
    counts = [*shares.values(), *([rest] if rest else [])]
    slots = sum(counts)
    if not counts or min(counts) < 1 or slots > LONGEST_PERIOD:
        raise ValueError(f"shares must be positive and sum to {LONGEST_PERIOD} at most")
    lanes = f"array({','.join(map(str, counts))})"
    # the state is the number of blocks each lane has placed and the lanes picked so far
    due = f"""array_min(transform({lanes}, (c, i) -> if(
        s.done[i] < c AND s.done[i] * {slots} div c <= t,
        named_struct('due', ((s.done[i] + 1) * {slots} + c - 1) div c, 'lane', i),
        named_struct('due', {slots} + 1L, 'lane', i)))).lane"""
    picked = F.expr(f"""aggregate(sequence(0, {slots - 1}),
        named_struct('done', array_repeat(0L, {len(counts)}), 'picks', cast(array() AS array<int>)),
        (s, t) -> named_struct(
            'done', transform(s.done, (d, i) -> if(i = {due}, d + 1, d)),
            'picks', concat(s.picks, array({due}))),
        s -> s.picks)""")
    order = Window.partitionBy("lane").orderBy("slot")
    return (
        spark.range(1).select(F.posexplode(picked).alias("slot", "lane"))
        .select("lane", (F.row_number().over(order) - 1).cast("long").alias("occurrence"), F.col("slot").cast("long").alias("slot"))
        .withColumn("share", F.element_at(F.expr(lanes), F.col("lane") + 1).cast("long"))
    )


def mix(docs: DataFrame, shares: Mapping[str, int], *, rest: int = 1, block_rows: int = 32, seed: int = 0) -> DataFrame:
    """The documents with lane, block, slot, position and in_mix; sort by position to read them in mixed order.

    ``shares`` gives the slots of a period for each named source; all other sources, and rows without one, share
    ``rest`` slots (0: they are not allowed and the rows keep null positions). Within a source, documents are
    ordered by a hash of seed and doc_id. Every row is kept. ``in_mix`` holds up to the first slot for which a
    source has no full block left; until there, each source's blocks differ from its weight by less than one block.
    Behind it the sources that still have rows keep their slots, so their proportions to each other stay.

    Null doc_ids are ordered like the empty string. Repeated rows each get a position of their own; which of two
    equal rows gets which is left open. Columns of docs that bear the name of an added column are replaced. An empty
    table gives an empty one. Plan: one exchange of the rows' own columns, on (lane, slice of the hash); a
    source of any size is ranked slice by slice, and only slice counts are summed per source.
    """
    spark = docs.sparkSession
    docs = without(docs, *ADDED)
    names = list(shares)
    lanes = F.lit(len(names) if rest else None).cast("int")
    for i, name in enumerate(names):
        lanes = F.when(F.col("source") == name, F.lit(i)).otherwise(lanes)
    plan = period(spark, shares, rest)
    slots = sum(shares.values()) + rest
    # about as many slices of the hash as there are rows in a slice
    rows = docs.select("source").count()
    digits = max(1, round(len(f"{max(rows, 1):b}") / 8))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    # rows of no lane get one of their own, so that one exchange serves the join and the window below
    keyed = docs.select("*", F.coalesce(lanes, F.lit(-1)).alias("lane"), key.alias("__key")).withColumn("__slice", F.substring("__key", 1, digits))

    sizes = keyed.groupBy("lane", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("lane").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lane", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))

    # where each lane first lacks a full block; a few rows, bounded by the number of shares
    totals = sizes.groupBy("lane").agg(F.sum("__n").alias("__n"))
    have = plan.select("lane", "share").distinct().join(totals, "lane", "left")
    full = F.floor(F.coalesce("__n", F.lit(0)) / block_rows)
    gap = have.select("lane", F.floor(full / F.col("share")).alias("__cycle"), (full % F.col("share")).alias("occurrence"))
    gap = gap.join(plan, ["lane", "occurrence"]).select("lane", (F.col("__cycle") * slots + F.col("slot")).alias("__gap"))
    table = plan.join(gap, "lane").withColumn("horizon", F.min("__gap").over(Window.partitionBy())).drop("__gap")

    in_slice = Window.partitionBy("lane", "__slice").orderBy("__key", "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    ranked = (
        keyed.join(starts, ["lane", "__slice"], "left")
        .withColumn("__rank", F.col("__start") + F.row_number().over(in_slice) - 1)
        .withColumn("block", F.floor(F.col("__rank") / block_rows))
    )
    table = table.select(*[F.col(c).alias(f"__p_{c}") for c in table.columns])
    # at most LONGEST_PERIOD rows
    placed = ranked.join(
        F.broadcast(table),
        (F.col("lane") == F.col("__p_lane")) & (F.col("block") % _share(len(names), shares, rest) == F.col("__p_occurrence")),
        "left",
    )
    slot = F.floor(F.col("block") / F.col("__p_share")) * slots + F.col("__p_slot")
    return (
        placed.withColumn("slot", slot)
        .withColumn("position", F.col("slot") * block_rows + F.col("__rank") % block_rows)
        .withColumn("in_mix", F.coalesce(F.col("slot") < F.col("__p_horizon"), F.lit(False)))
        .withColumn("lane", F.when(F.col("lane") >= 0, F.col("lane")))
        .select(*[f"`{c}`" for c in docs.columns], *ADDED)
    )


def _share(n: int, shares: Mapping[str, int], rest: int):
    counts = [*shares.values(), *([rest] if rest else [])]
    return F.get(F.array(*[F.lit(c).cast("long") for c in counts]), F.col("lane"))
