"""Joins, ranks and running frames that stay spread out when one key dominates.

Assume a single key may hold a third of all rows: nothing here puts the rows of one key
into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryscore.scratch import materialise

#: A key with more than one in so many of the rows, and at least so many rows, is dealt to several tasks.
HEAVY_SHARE, HEAVY_ROWS = 1000, 1000


def left_join_skewed(
    rows: DataFrame, dim: DataFrame, keys: list[str], weight: str | None = None,
    heavy: int = HEAVY_SHARE, least: int = HEAVY_ROWS,
) -> DataFrame:
    """Left join to ``dim`` (one row per key) that no single key can unbalance.

    A key with more than 1/``heavy`` of the rows is cut into slices of about that size, and its row
    of ``dim`` is repeated for each of them: at most 2 * ``heavy`` rows are added, and they are
    shuffled like all others, so wide payload needs no memory of a task. What is broadcast is the
    hash and the number of slices of the heavy keys, fewer than ``heavy`` rows of 12 bytes; with
    even keys it is empty. Rows with a null key are dealt out evenly.

    ``weight`` names a ``dim`` column with the number of rows per key, if ``dim`` has it
    for every key; otherwise the rows are counted.
    """
    payload = [c for c in dim.columns if c not in keys]
    # Equal keys have equal codes on both sides; keys that share a code by chance are only cut alike.
    own = F.xxhash64(*keys)
    other = F.xxhash64(*[F.col(k).try_cast(rows.schema[k].dataType) for k in keys])
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if weight is None:
        counted = rows.where(has_key).groupBy(own.alias("_code")).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        counted = dim.groupBy(other.alias("_code")).agg(F.sum(weight).alias("_rows"))
    total = counted.agg(F.sum("_rows")).scalar()
    share = F.col("_rows") * heavy / total
    hot = counted.where((F.col("_rows") >= least) & (share > 1)).select("_code", F.ceil(share).cast("bigint").alias("_slices"))
    slices = F.coalesce("_slices", F.lit(1).cast("bigint"))
    served = dim.select(*keys, F.struct(F.lit(0).alias("_"), *payload).alias("_served"), other.alias("_code")).join(F.broadcast(hot), "_code", "left")
    served = served.select(*keys, "_served", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("_slice"))
    # Never a constant: one would be folded out of the join keys, and a heavy key would meet in one partition again.
    number = F.monotonically_increasing_id()
    slice_ = F.when(has_key, F.pmod(number, slices)).otherwise(F.pmod(number, F.lit(heavy)))
    dealt = rows.withColumn("_code", own).join(F.broadcast(hot), "_code", "left").withColumn("_slice", slice_)
    joined = dealt.join(served, [*keys, "_slice"], "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.col("_served").getField(c).alias(c) for c in payload])


def first_per_group(
    df: DataFrame, keys: list[str], order: str, n: int, descending: bool = False,
) -> DataFrame:
    """The first ``n`` rows of every key by ``order`` (unique within a key).

    Ranked twice: within salted slices of a key on all tasks, then among the few
    survivors. Spark trims to ``n`` before each shuffle as well.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(order).desc() if descending else F.col(order).asc()
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(slices)))
    local = Window.partitionBy(*keys, "_slice").orderBy(by)
    final = Window.partitionBy(*keys).orderBy(by)
    return (
        sliced.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= n)
        .drop("_rank", "_slice")
    )


#: Up to so many first rows are found by a heap in each task, more by counts.
SMALL_HEAD = 10_000


def dealt_by_order(places: DataFrame, order: str) -> DataFrame:
    """``places`` plus ``_task``: dealt to tasks by ranges of ``order``, written once."""
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = places.repartitionByRange(tasks, order).withColumn("_task", F.spark_partition_id())
    return materialise(spread, "places")


def nth_by_counts(dealt: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """(keys, _last): the ``n``-th value of ``order`` (unique) of every key that has as many rows.

    Counts per key and range of values tell the range in which the ``n``-th row lies; only the rows
    of that range are ranked, so the largest group that meets in one task is a task's range.
    """
    counts = dealt.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cutting = counts.where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).select(*keys, "_task", (n - F.col("_before")).alias("_need"))
    inside = Window.partitionBy(*keys, "_task").orderBy(order)
    ranked = dealt.join(cutting, [*keys, "_task"]).withColumn("_rank", F.row_number().over(inside))
    return ranked.where("_rank = _need").select(*keys, F.col(order).alias("_last"))


def first_rows(df: DataFrame, n: int, order: str | Column) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``order``, sorted; a large head does not meet in one task.

    Rows of equal order stand in any order, and any of them may be the last ones.
    """
    if n <= SMALL_HEAD:
        return df.orderBy(order).limit(n)
    by = F.col(order) if isinstance(order, str) else order
    # an order that is not unique is told apart by the place of the row
    rows = materialise(df.withColumn("_place", F.struct(by.alias("by"), F.monotonically_increasing_id().alias("row"))), "rows")
    last = nth_by_counts(dealt_by_order(rows.select("_place"), "_place"), [], "_place", n).agg(F.max("_last")).scalar()
    return rows.where(last.isNull() | (F.col("_place") <= last)).orderBy("_place").drop("_place")


def with_position(
    df: DataFrame, keys: list[str], order: str, name: str = "position", block: int = 4096,
) -> DataFrame:
    """Add the 1-based position of each row within its key by an integer ``order`` column.

    Rows are numbered inside blocks of the order range; block starts come from counts.
    ``order`` must be unique within a key.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_block", "_start")
    )


def rolling_mean_by_position(
    df: DataFrame, keys: list[str], value: str, position: str, window: int,
    name: str, block: int = 4096,
) -> DataFrame:
    """Mean over the last ``window`` positions; positions with fewer rows are left out.

    Positions are cut into blocks; each block also gets the last ``window`` - 1 rows of
    the block before it, so every frame lies inside one group of bounded size.
    """
    block = max(block, window)
    at = F.col(position) - 1
    own = F.floor(at / block)
    reaches_next = (at % block) >= block - (window - 1)
    copies = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    frame = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-(window - 1), 0)
    return (
        df.withColumn("_block", F.explode(copies))
        .withColumn(name, F.avg(value).over(frame))
        .filter((F.col("_block") == own) & (F.col(position) >= window))
        .drop("_block")
    )
