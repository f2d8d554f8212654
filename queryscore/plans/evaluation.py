"""From transcripts to scored results and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.functions.messages import completion_text
from queryscore.functions.sql_text import extract_final_sql, is_select
from queryscore.operators.execution import EMPTY_SQL, DatabaseSessions, match_batch
from queryscore.operators.outcomes import OutcomeStore
from queryscore.operators.rewards import reward_matched
from queryscore.operators.transcripts import complete_results, rollout_outcome
from queryscore.scratch import materialise


def evaluate(
    spark: SparkSession, turns: DataFrame, questions: DataFrame, databases: DataFrame,
    arm: str = "r1", max_turns: int = fv.MAX_TURNS, store: OutcomeStore | None = None,
    failed: DataFrame | None = None, **limits,
) -> DataFrame:
    """One result per question: final query, match, reward, fallback match, turns, finished.

    A transcript belongs to the question whose ``qid`` is its ``rollout_id``. The ``s0``
    arm reads transcripts in single-shot mode. A rollout that committed nothing is run on
    its fallback query in the same batch, which counts for ``ex_fallback`` only.

    ``failed`` is (qid, error) of rollouts that broke off: whatever they have left does not
    count, and their results are zero rows with the error. A question without a transcript
    is one too.
    """
    if failed is not None:
        failed = materialise(failed.groupBy("qid").agg(F.coalesce(F.min("error"), F.lit("")).alias("error")), "failed")
    outcomes = rollout_outcome(turns, max_turns, single_shot=arm == "s0")
    asked = questions.select("qid", "db_id", "question", "gold_sql")
    attempt = F.coalesce("final_sql", F.nullif("fallback_sql", F.lit("")))
    named = outcomes.withColumnRenamed("rollout_id", "qid")
    if failed is not None:
        named = named.join(failed, "qid", "left_anti")
    rollouts = materialise(
        named.join(asked, "qid")
        .withColumn("pred_sql", attempt),
        "rollouts",
    )
    sessions = DatabaseSessions(spark)
    matched = match_batch(spark, rollouts, databases, sessions=sessions, store=store, **limits)
    committed = F.col("final_sql").isNotNull()
    strict = matched.withColumns({
        "ex_fallback": F.when(is_select(F.col("pred_sql")), F.col("ex")).otherwise(F.lit(0)),
        "ex": F.when(committed, F.col("ex")).otherwise(F.lit(0)),
        "pred_status": F.when(committed, F.col("pred_status")).otherwise(EMPTY_SQL),
        "pred_sql": F.col("final_sql"),
    })
    results = reward_matched(spark, strict, databases, arm, sessions, store)
    if failed is not None:
        results = results.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
    whole = complete_results(asked, results, carry=("fallback_sql", "ex_fallback", "breakdown"))
    return whole.withColumn("ex_fallback", F.coalesce("ex_fallback", "ex"))


def evaluate_single_turn(
    spark: SparkSession, completions: DataFrame, questions: DataFrame, databases: DataFrame,
    failed: DataFrame | None = None, store: OutcomeStore | None = None, **limits,
) -> DataFrame:
    """(qid, db_id, final_sql, ex, finished, error) of every question, from one completion each.

    ``completions`` has (qid, completion), a text or an array of messages. Whatever query a
    completion commits is run, a SELECT by its first word or not: the match alone decides. A question
    without a completion, or one in ``failed`` (qid, error), is a zero row with its error.
    """
    done = F.col("completion")
    text = completion_text(done) if completions.schema["completion"].dataType.typeName() == "array" else done
    answers = completions.select("qid", extract_final_sql(text).alias("pred_sql"))
    if failed is not None:
        answers = answers.join(failed.select("qid"), "qid", "left_anti")
    asked = questions.select("qid", "db_id", "gold_sql")
    pairs = materialise(answers.join(asked, "qid"), "pairs")
    matched = match_batch(spark, pairs, databases, store=store, **limits).select("qid", F.col("pred_sql").alias("final_sql"), "ex")
    found = matched.withColumn("error", F.lit(None).cast("string"))
    if failed is not None:
        bad = failed.groupBy("qid").agg(F.coalesce(F.min("error"), F.lit("")).alias("error"))
        found = found.unionByName(bad, allowMissingColumns=True)
    error = F.substring(F.coalesce("error", F.when(F.col("ex").isNull(), F.lit("no result"))), 1, fv.ERROR_CHARS)
    return asked.select("qid", "db_id").join(found, "qid", "left").select(
        "qid", "db_id", "final_sql", F.coalesce("ex", F.lit(0)).alias("ex"),
        F.col("final_sql").isNotNull().alias("finished"), error.alias("error"),
    )
