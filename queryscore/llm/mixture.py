"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's target over its
words. Documents stand in a fixed order, their expected copies are summed up along it, and a
document is emitted once for every integer its stretch of that sum crosses after one random
offset was added. In an order by size the copies of short and long documents interleave, so the
words taken miss the target by about one longest document at most.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryscore.llm.native import n_words
from queryscore.llm.scratch import kept

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 9


def offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    The targets share ``share`` of all words by weight; none exceeds ``most`` times its source.
    With the sources in order of size per weight, those at their limit come first: a source is at
    its limit when the rest, shared by weight among it and all after it, would give it as much.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    up_to = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    limit, budget = F.col("source_size") * most, share * F.col("_all")
    at_limit = limit * F.col("_later") <= (budget - (F.col("_sizes") - F.col("source_size")) * most) * F.col("_weight")
    rest = budget - F.sum(F.when(F.col("_full"), limit).otherwise(0)).over(everything)
    weights_left = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(everything)
    return (
        sizes.withColumn("_weight", weight.cast("bigint"))
        .withColumn("_ratio", F.col("source_size") / F.col("_weight"))
        .withColumns({
            "_all": F.sum("source_size").over(everything),
            "_sizes": F.sum("source_size").over(up_to),
            "_later": F.sum("_weight").over(everything) - F.sum("_weight").over(up_to) + F.col("_weight"),
        })
        .withColumn("_full", at_limit)
        .select(
            "source", "source_size",
            F.when(F.col("_full"), limit.cast("double")).otherwise(rest * F.col("_weight") / weights_left).alias("target"),
        )
    )


def _crossed(rank: Column, rate: Column, start: float) -> Column:
    at = lambda k: F.floor(k * rate + F.lit(start))
    return at(rank + 1) - at(rank)


def mix(
    docs: DataFrame, carry: list[str] | None = None, weights=WEIGHTS, share: float = SHARE,
    most: int = MOST_COPIES, seed: int = SEED,
) -> DataFrame:
    """The columns ``carry`` (default: all) of every document plus size, source_size, target, copies, taken.

    Columns of these names in ``docs`` give way, whatever they hold. A null text has size 0; documents without words
    have copies too, which take no words. A null source is a source, the last one. Documents of
    equal size are ordered by doc_id (nulls first), then by their content; rows equal in all of
    that are interchangeable. An empty table gives an empty table.

    The order is a range sort over all tasks; a rank is the row's place in its task plus the rows
    of its source in earlier tasks, so no source meets in one task.
    """
    carry = docs.columns if carry is None else carry
    added = ("size", "source_size", "target", "copies", "taken")
    doc = F.struct(*[docs[c] for c in carry]).alias("_doc")
    rows = docs.select(doc, docs["source"], n_words(docs["text"]).alias("size"), docs["doc_id"])
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("_tie"), F.col("_any")]
    place = F.monotonically_increasing_id()
    placed = kept(
        rows.withColumn("_tie", F.xxhash64("_doc")).withColumn("_any", F.rand(seed))
        .repartitionByRange(*order).sortWithinPartitions(*order).select("_doc", "source", "size", place.alias("_place")),
        "mixture",
    ).withColumn("_task", F.shiftright("_place", 33))
    per_task = placed.groupBy("source", "_task").agg(
        F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    goal = targets(per_task.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_task.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select(
            F.col("source").alias("_source"), F.col("_task").alias("_at"), "source_size", "target",
            (F.col("_before") - F.col("_first")).alias("_shift"),
        )
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = _crossed(F.col("_place") + F.col("_shift"), rate, offset(seed))
    joined = placed.join(starts, (F.col("_task") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("copies", copies).select(
        *[F.col("_doc")[c].alias(c) for c in carry if c not in added],
        "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it, numbered by ``copy`` from 1.

    All columns of ``docs`` stay but one named copy. Only ids and sizes are ranked; the documents are
    joined to their copies once. Rows equal in all columns share their key: their copies are counted
    together and put out from one of them.
    """
    key = F.xxhash64(F.struct(*docs.columns))
    mixed = mix(docs.select("doc_id", "source", "text", key.alias("_key")), carry=["doc_id", "_key"], **options)
    counted = mixed.groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    counted = kept(counted.where("_copies > 0"), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), docs["doc_id"].alias("_own"), key.alias("_own_key"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_key") == F.col("_key"))
    single = rows.join(counted.where("_rows = 1"), same).select("_doc", "_copies")
    # the first of some equal rows is as good as any
    many = rows.join(counted.where("_rows > 1"), same).groupBy("_own", "_own_key").agg(F.first("_doc").alias("_doc"), F.first("_copies").alias("_copies"))
    both = single.unionByName(many.select("_doc", "_copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return both.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c != "copy"], copy.alias("copy"))
