"""Rewards of predicted queries.

Input rows come from ``match_batch`` (``pred_sql, gold_sql, ex``), with ``executes`` from
``with_executes`` where a reward needs it. Every reward adds ``reward``, a gated ``ex``
and a ``breakdown`` struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.functions.messages import called_describe, completion_text
from queryscore.functions.similarity import jaccard
from queryscore.functions.sql_text import extract_final_sql, is_select
from queryscore.operators.execution import DatabaseSessions, match_batch, with_executes
from queryscore.operators.outcomes import OutcomeStore
from queryscore.operators.skew import left_join_skewed
from queryscore.operators.texts import with_parts
from queryscore.scratch import materialise


def _if_valid(value: Column) -> Column:
    """0 unless valid; a product, not a branch, so that shared parts are computed once."""
    return F.col("valid_sql").cast("double") * value


def _gated(scored: DataFrame) -> DataFrame:
    """Add ``valid_sql`` and set ``ex`` to 0 where the prediction is not a SELECT."""
    valid = is_select(F.col("pred_sql"))
    return scored.withColumn("valid_sql", valid).withColumn(
        "ex", F.when(valid, F.col("ex")).otherwise(F.lit(0))
    )


def reward_r1(scored: DataFrame) -> DataFrame:
    """Execution match only."""
    return (
        _gated(scored)
        .withColumn("reward", F.col("ex").cast("double"))
        .withColumn("breakdown", F.struct("valid_sql", "ex"))
    )


def reward_r2(scored: DataFrame) -> DataFrame:
    """Partial credit: execution match, executability, schema and token overlap, format.

    Schema items and token pairs come from a dictionary of the distinct texts, so a gold that is
    shared by many predictions is taken apart once. A prediction that is known not to be SQL has no
    schema items.
    """
    scored = materialise(scored, "scored")
    known = with_parts(scored, {"_pred": "pred_sql", "_gold": "gold_sql"})
    none = F.array().cast("array<string>")
    of = lambda side, part: F.coalesce(F.col(f"{side}.{part}"), none)
    parsed = F.coalesce("pred_parsed", F.lit(True)) if "pred_parsed" in scored.columns else F.lit(True)
    parts = (
        _gated(known)
        .withColumn("syntax", _if_valid(((F.col("ex") == 1) | F.col("executes")).cast("int")))
        .withColumn("schema", _if_valid(jaccard(F.when(parsed, of("_pred", "items")).otherwise(none), of("_gold", "items"))))
        .withColumn("ngram", _if_valid(jaccard(of("_pred", "grams"), of("_gold", "grams"))))
        .withColumn("format", _if_valid(F.lit(1.0)))
        .drop("_pred", "_gold")
    )
    reward = (
        fv.R2_EXEC * F.col("ex") + fv.R2_SYNTAX * F.col("syntax") + fv.R2_SCHEMA * F.col("schema")
        + fv.R2_NGRAM * F.col("ngram") + fv.R2_FORMAT * F.col("format")
    )
    breakdown = F.struct(
        "ex", "syntax", F.round("schema", 3).alias("schema"), F.round("ngram", 3).alias("ngram"),
        "format", "valid_sql",
    )
    return (
        parts.withColumn("reward", reward).withColumn("breakdown", breakdown)
        .drop("syntax", "schema", "ngram", "format")
    )


def reward_r3(scored: DataFrame) -> DataFrame:
    """Process reward; needs a ``called_describe`` column. Executability is not gated."""
    reward = (
        fv.R3_DESCRIBE * F.col("called_describe").cast("double")
        + fv.R3_EXECUTABLE * F.col("executes").cast("double")
        + fv.R3_EXEC * F.col("ex")
    )
    return (
        _gated(scored)
        .withColumn("reward", reward)
        .withColumn(
            "breakdown", F.struct("called_describe", F.col("executes").alias("executable"), "ex")
        )
    )


def reward_s0(scored: DataFrame) -> DataFrame:
    """Single-shot arm: the plain execution reward, on single-shot outcomes."""
    return reward_r1(scored)


_REWARDS = {"r1": reward_r1, "r2": reward_r2, "r3": reward_r3, "s0": reward_s0}


def reward_matched(
    spark: SparkSession, scored: DataFrame, databases: DataFrame, arm: str,
    sessions: DatabaseSessions | None = None, store: OutcomeStore | None = None,
) -> DataFrame:
    """Reward rows that ``match_batch`` has judged, trying first rows where the arm asks."""
    if arm not in _REWARDS:
        raise ValueError(f"unknown reward arm {arm!r}; choose from {sorted(_REWARDS)}")
    if arm in ("r2", "r3"):
        scored = with_executes(spark, scored, databases, sessions=sessions, store=store)
    return _REWARDS[arm](scored)


def score_pairs(
    spark: SparkSession, pairs: DataFrame, databases: DataFrame, arm: str,
    store: OutcomeStore | None = None, **limits
) -> DataFrame:
    """Execute, match and reward (db_id, pred_sql, gold_sql) rows under one arm.

    With ``store`` a text that has run before, such as the gold of a question that comes again in
    the next training step, does not run again while its database is the same.
    """
    sessions = DatabaseSessions(spark)
    scored = match_batch(spark, pairs, databases, sessions=sessions, store=store, **limits)
    return reward_matched(spark, scored, databases, arm, sessions, store)


def score_completions(
    spark: SparkSession, completions: DataFrame, questions: DataFrame, databases: DataFrame,
    arm: str = "r1", **limits,
) -> DataFrame:
    """Rewards of model completions, one row each.

    ``completions`` has ``qid`` and ``completion``, a text or an array of messages;
    ``questions`` has (qid, db_id, gold_sql).
    """
    done = F.col("completion")
    if completions.schema["completion"].dataType.typeName() == "array":
        text, described = completion_text(done), called_describe(done)
    else:
        text, described = done, F.coalesce(done.contains(fv.DESCRIBE_TABLE), F.lit(False))
    answers = completions.select(
        *[c for c in completions.columns if c != "completion"],
        extract_final_sql(text).alias("pred_sql"), described.alias("called_describe"),
    )
    golds = questions.select("qid", "db_id", "gold_sql")
    pairs = materialise(left_join_skewed(answers, golds, ["qid"]), "pairs")
    return score_pairs(spark, pairs, databases, arm, **limits)
