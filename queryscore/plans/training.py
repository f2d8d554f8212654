"""From sampled completions to advantages and the training signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queryscore.operators.metrics import gradient_density, group_advantage
from queryscore.operators.rewards import score_completions
from queryscore.scratch import materialise


def score_step(
    spark: SparkSession, completions: DataFrame, questions: DataFrame, databases: DataFrame,
    arm: str = "r2", **limits,
) -> tuple[DataFrame, DataFrame]:
    """(rewards with group-relative advantages, signal density per step).

    ``completions`` has (step, qid, completion).
    """
    rewards = materialise(
        score_completions(spark, completions, questions, databases, arm, **limits), "rewards"
    )
    return group_advantage(rewards), gradient_density(rewards)
