"""Summaries, comparisons and training-log statistics: plain aggregates that Spark
combines before its shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.functions.sql_text import is_select
from queryscore.operators.skew import (
    first_per_group, left_join_skewed, rolling_mean_by_position, with_position,
)


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def _rate(flag: Column) -> Column:
    return _mean(F.coalesce(flag, F.lit(False)).cast("int"))


def _ex_fallback(results: DataFrame) -> Column:
    return F.coalesce("ex_fallback", "ex") if "ex_fallback" in results.columns else F.col("ex")


def _summary(results: DataFrame, valid: Column, by: str | None) -> DataFrame:
    grouped = results.groupBy(by) if by else results.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        _mean(F.col("ex")).alias("ex_rate"),
        _mean(_ex_fallback(results)).alias("ex_rate_fallback"),
        _mean(F.col("reward")).alias("mean_reward"),
        _rate(F.col("finished")).alias("finished_rate"),
        _rate(valid).alias("valid_sql_rate"),
        _mean(F.col("turns")).alias("avg_turns"),
    )


def summarize(results: DataFrame, by: str | None = None) -> DataFrame:
    """Evaluation summary; a query is valid when it starts like a SELECT."""
    return _summary(results, is_select(F.col("final_sql")), by)


def compare_summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """Comparison summary; a query is valid when there is one at all."""
    return _summary(results, F.coalesce("final_sql", F.lit("")) != "", by)


def compare(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row: both summaries (prefixed), their match-rate deltas and ``passed``."""
    b = compare_summary(baseline)
    t = compare_summary(tuned)
    other = t.select(F.struct("*")).scalar()
    sides = b.select(
        *[F.col(c).alias(f"baseline_{c}") for c in b.columns], other.alias("_tuned")
    ).select("*", *[F.col(f"_tuned.{c}").alias(f"tuned_{c}") for c in t.columns]).drop("_tuned")
    delta = F.col("tuned_ex_rate") - F.col("baseline_ex_rate")
    return sides.select(
        "*", delta.alias("ex_delta"),
        (F.col("tuned_ex_rate_fallback") - F.col("baseline_ex_rate_fallback")).alias("ex_delta_fallback"),
        (delta > 0).alias("passed"),
    )


def summarize_singleturn(results: DataFrame, by: str | None = None) -> DataFrame:
    grouped = results.groupBy(by) if by else results.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("ex"), F.lit(0)).cast("long").alias("n_ex"),
        _mean(F.col("ex")).alias("ex_rate"),
        _rate(F.col("finished")).alias("finished_rate"),
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def keep_ratio(filtered: DataFrame) -> DataFrame:
    """(kept, total, ratio) of rows with a ``keep`` flag."""
    kept = F.count(F.when(F.col("keep"), F.lit(1)))
    total = F.count(F.lit(1))
    return filtered.agg(
        kept.alias("kept"), total.alias("total"),
        (kept / F.greatest(total, F.lit(1))).alias("ratio"),
    )


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Chebyshev fit, relative error < 1.2e-7)."""
    t = 1 / (1 + x / 2)
    coefficients = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def proportion_ztest(results: DataFrame, base_tag: str, tag: str = "tag", hit: str = "ex") -> DataFrame:
    """Pooled two-proportion z-test of every tag's ``hit`` rate against one base tag.

    (tag, n, rate, delta, z, p_value); z is null when the pooled variance is zero.
    """
    per_tag = results.groupBy(F.col(tag).alias("tag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("hits")
    )
    base = per_tag.filter(F.col("tag") == base_tag).select(F.struct("n", "hits")).scalar()
    compared = per_tag.filter(F.col("tag") != base_tag).withColumn("_base", base).select(
        "*", F.col("_base.n").alias("base_n"), F.col("_base.hits").alias("base_hits")
    )
    rate = F.col("hits") / F.col("n")
    base_rate = F.col("base_hits") / F.col("base_n")
    pooled = (F.col("hits") + F.col("base_hits")) / (F.col("n") + F.col("base_n"))
    variance = pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("base_n"))
    z = F.when(variance > 0, (rate - base_rate) / F.sqrt(variance))
    return (
        compared.select("tag", "n", rate.alias("rate"), (rate - base_rate).alias("delta"), z.alias("z"))
        .withColumn("p_value", _erfc(F.abs("z") / math.sqrt(2)))
    )


def group_advantage(rollouts: DataFrame, group: str = "qid", reward: str = "reward") -> DataFrame:
    """Add ``advantage``: reward minus its group's mean, over the group's sample deviation.

    Groups of one row or of equal rewards get 0. The statistics are aggregated first and
    joined back, so a group of any size is only ever one row in one place.
    """
    value = F.col(reward)
    stats = rollouts.groupBy(group).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
        (F.min(value) == F.max(value)).alias("_flat"), F.count(F.lit(1)).alias("_n"),
    )
    joined = left_join_skewed(rollouts, stats, [group], "_n")
    signal = (F.col("_std") > 0) & ~F.col("_flat")
    scaled = F.when(signal, (value - F.col("_mean")) / F.col("_std"))
    return joined.select(
        *[joined[c] for c in rollouts.columns], F.coalesce(scaled, F.lit(0.0)).alias("advantage")
    )


def gradient_density(
    rollouts: DataFrame, step: str = "step", group: str = "qid", reward: str = "reward"
) -> DataFrame:
    """(step, n_groups, density): share of groups whose rewards are not all equal."""
    varied = (F.min(reward) != F.max(reward)).cast("int")
    return (
        rollouts.groupBy(step, group).agg(varied.alias("varied"))
        .groupBy(step).agg(F.count(F.lit(1)).alias("n_groups"), F.avg("varied").alias("density"))
    )


def rolling_mean(
    log: DataFrame, window: int = fv.ROLLING_WINDOW, arm: str = "arm", step: str = "step",
    value: str = "reward",
) -> DataFrame:
    """(arm, step, position, rolling): mean of the last ``window`` steps, full windows only."""
    placed = with_position(log.select(arm, step, value), [arm], step)
    return rolling_mean_by_position(placed, [arm], value, "position", window, "rolling").drop(value)


def normalise_reward(
    log: DataFrame, maxima: dict[str, float], arm: str = "arm", value: str = "reward"
) -> DataFrame:
    """Add ``normalised``: the reward over the largest reward of its arm (null if unknown)."""
    largest = F.create_map(*[F.lit(x) for pair in maxima.items() for x in pair])
    return log.withColumn("normalised", F.col(value) / F.try_element_at(largest, F.col(arm)))


def tail_mean(
    log: DataFrame, n: int = fv.TAIL_STEPS, arm: str = "arm", step: str = "step", value: str = "reward"
) -> DataFrame:
    """(arm, n, tail_mean): mean of the last ``n`` steps of every arm."""
    last = first_per_group(log.select(arm, step, value), [arm], step, n, descending=True)
    return last.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("tail_mean"))


def metric_pivot(results: DataFrame, arms: list[str], arm: str = "arm") -> DataFrame:
    """Metric × arm table in percent: match, finished and valid-SQL rates."""
    rates = summarize(results, arm).select(
        arm, *[
            F.round(F.col(f"{name}_rate") * 100, 4).alias(name)
            for name in ("ex", "finished", "valid_sql")
        ],
    )
    return (
        rates.unpivot([arm], ["ex", "finished", "valid_sql"], "metric", "percent")
        .groupBy("metric").pivot(arm, arms).agg(F.first("percent"))
    )


def token_count(text: Column) -> Column:
    """Number of white-space separated tokens."""
    spaces = F.translate(text, fv.SPACE_CHARS, " " * len(fv.SPACE_CHARS))
    return F.size(F.array_remove(F.split(spaces, " "), ""))


def length_profile(
    corpus: DataFrame, length: Column, limit: int, by: str | None = None
) -> DataFrame:
    """(n, p99, max_length, over_limit): exact, from counts per distinct length."""
    keys = [by] if by else []
    counts = corpus.select(*keys, length.alias("length")).groupBy(*keys, "length").agg(
        F.count(F.lit(1)).alias("copies")
    )
    over = F.sum(F.when(F.col("length") > limit, F.col("copies")).otherwise(F.lit(0)))
    return counts.groupBy(*keys).agg(
        F.sum("copies").alias("n"),
        F.percentile("length", F.lit(0.99), F.col("copies")).alias("p99"),
        F.max("length").alias("max_length"),
        (over / F.sum("copies")).alias("over_limit"),
    )
