"""Outcomes of tool-use transcripts.

Input: one row per message, ``(rollout_id, turn, role, content, tool_calls)``, ``turn``
being the message position. Only assistant messages count as turns. A window over a
rollout would be unsafe if one rollout dominates, so the first step keeps at most
``max_turns`` messages per rollout, which Spark trims before the shuffle; everything
after it works on that bounded remainder in the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.functions.messages import TOOL_CALL
from queryscore.functions.sql_text import extract_final_sql, is_select
from queryscore.operators.execution import match_batch
from queryscore.operators.skew import left_join_skewed

_TOOLS = [fv.LIST_TABLES, fv.DESCRIBE_TABLE, fv.RUN_SQL]


def call_args(arguments: Column) -> Column:
    """Tool arguments as a map; null, empty or malformed JSON gives an empty map.

    Of a repeated key the last value counts.
    """
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    read = F.coalesce(F.from_json(arguments, "map<string,string>"), empty)

    def last_values(found: Column) -> Column:
        entries, keys = F.map_entries(found), F.array_distinct(F.map_keys(found))
        last = lambda key: F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"]
        repeated = F.size(keys) < F.size(F.map_keys(found))
        return F.when(repeated, F.map_from_arrays(keys, F.transform(keys, last))).otherwise(found)

    return F.element_at(F.transform(F.array(read), last_values), 1)


def _counted(turns: DataFrame, max_turns: int, single_shot: bool) -> DataFrame:
    """Assistant turns up to the end of each rollout, numbered by ``n``.

    Adds ``end_n`` (null when unfinished) and whether the end is a ``final`` answer. A
    rollout without assistant messages keeps one row, not marked ``assistant``.
    """
    is_assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = F.coalesce("tool_calls", F.array().cast(f"array<{TOOL_CALL}>"))
    # The message text is reduced to its query here, so that it never enters the shuffle.
    narrow = turns.select(
        "rollout_id", "turn", is_assistant.alias("assistant"),
        F.when(is_assistant, extract_final_sql(F.col("content"))).alias("final_sql"),
        F.when(is_assistant, calls).alias("calls"),
    )
    first = Window.partitionBy("rollout_id").orderBy(F.desc("assistant"), "turn")
    ranked = narrow.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= max_turns)
    marked = ranked.withColumn(
        "run_calls", F.filter("calls", lambda c: F.coalesce(c["name"] == fv.RUN_SQL, F.lit(False)))
    )
    ends = F.col("final_sql").isNotNull()
    if single_shot:
        ends = ends | (F.size("run_calls") > 0)
    whole = Window.partitionBy("rollout_id")
    return (
        marked.withColumn("end_n", F.min(F.when(ends, F.col("n"))).over(whole))
        .filter(F.col("end_n").isNull() | (F.col("n") <= F.col("end_n")))
    )


def _calls_until_answer() -> Column:
    """Calls of a single-shot turn up to and with its first ``run_sql``."""
    at = F.array_position(F.transform("calls", lambda c: c["name"]), fv.RUN_SQL)
    return F.when(at > 0, F.slice("calls", F.lit(1), at.cast("int"))).otherwise(F.col("calls"))


def _run_query(call: Column) -> Column:
    return call_args(call["arguments"])["query"]


def rollout_outcome(
    turns: DataFrame, max_turns: int = fv.MAX_TURNS, single_shot: bool = False
) -> DataFrame:
    """(rollout_id, final_sql, finished, turns, called_describe, fallback_sql) per rollout.

    The first assistant turn with a final query ends a rollout; its own tool calls do not
    count. In single-shot mode the first ``run_sql`` call ends it too, its query being the
    answer. The fallback is the last counted ``run_sql`` query that is not empty.
    """
    rows = _counted(turns, max_turns, single_shot)
    # Calls count on every assistant turn that did not commit a final query.
    counts = F.col("assistant") & F.col("final_sql").isNull()
    calls = _calls_until_answer() if single_shot else F.col("calls")
    queries = F.transform(
        F.filter(calls, lambda c: F.coalesce(c["name"] == fv.RUN_SQL, F.lit(False))), _run_query
    )
    filled = F.filter(queries, lambda q: F.coalesce(q != "", F.lit(False)))
    last_query = F.when(counts & (F.size(filled) > 0), F.try_element_at(filled, F.lit(-1)))
    called = F.when(counts & F.lit(single_shot), F.get(queries, F.lit(0)))
    answer = F.coalesce("final_sql", called)
    at_end = F.col("n") == F.col("end_n")
    described = counts & F.exists(
        calls, lambda c: F.coalesce(c["name"] == fv.DESCRIBE_TABLE, F.lit(False))
    )
    prepared = rows.select(
        "rollout_id", "n", "assistant", "end_n",
        F.when(at_end, answer).alias("answer"), last_query.alias("last_query"),
        described.alias("described"),
    )
    return prepared.groupBy("rollout_id").agg(
        F.max("answer").alias("final_sql"),
        F.max("end_n").isNotNull().alias("finished"),
        F.count(F.when(F.col("assistant"), F.lit(1))).cast("int").alias("turns"),
        F.coalesce(F.max("described"), F.lit(False)).alias("called_describe"),
        F.max_by("last_query", F.when(F.col("last_query").isNotNull(), F.col("n"))).alias("fallback_sql"),
    )


def fallback_sql(turns: DataFrame, max_turns: int = fv.MAX_TURNS, single_shot: bool = False) -> DataFrame:
    """(rollout_id, fallback_sql)."""
    return rollout_outcome(turns, max_turns, single_shot).select("rollout_id", "fallback_sql")


def tool_call_log(
    turns: DataFrame, max_turns: int = fv.MAX_TURNS, single_shot: bool = False
) -> DataFrame:
    """Counted tool calls: (rollout_id, turn, call_pos, name, args, error); error is null when valid."""
    rows = _counted(turns, max_turns, single_shot).filter(
        F.col("assistant") & F.col("final_sql").isNull()
    )
    calls = _calls_until_answer() if single_shot else F.col("calls")
    exploded = rows.select("rollout_id", "turn", F.posexplode(calls).alias("call_pos", "call"))
    args = call_args(F.col("call.arguments"))
    has = lambda key: F.map_contains_key("args", key)
    name = F.col("name")
    error = (
        F.when(~F.coalesce(name.isin(*_TOOLS), F.lit(False)), F.concat(F.lit("unknown tool '"), F.coalesce(name, F.lit("")), F.lit("'")))
        .when((name == fv.DESCRIBE_TABLE) & ~has("table"), F.lit("missing argument 'table'"))
        .when((name == fv.RUN_SQL) & ~has("query"), F.lit("missing argument 'query'"))
    )
    return (
        exploded.select("rollout_id", "turn", "call_pos", F.col("call.name").alias("name"), args.alias("args"))
        .withColumn("error", error)
    )


def complete_results(
    questions: DataFrame, results: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One result per question; a missing one is a zero row carrying its ``error`` text.

    ``results`` has (qid, final_sql, ex, reward, turns, finished) and may have ``error``
    for rollouts that failed; the ``carry`` columns come along, null where it failed.
    Order by ``qid`` when writing to keep the question order.
    """
    failed = F.lit(None).cast("string")
    if "error" in results.columns:
        failed = F.substring("error", 1, fv.ERROR_CHARS)
    keep = [c for c in ("db_id", "question") if c in questions.columns]
    got = results.select(
        "qid", "final_sql", "ex", "reward", "turns", "finished", failed.alias("error"), *carry
    )
    ok = F.col("error").isNull()
    zero = lambda c, v: F.coalesce(F.when(ok, F.col(c)), F.lit(v)).alias(c)
    return questions.select("qid", *keep).join(got, "qid", "left").select(
        "qid", *keep, F.when(ok, F.col("final_sql")).alias("final_sql"),
        zero("ex", 0), zero("reward", 0.0), zero("turns", 0), zero("finished", False),
        F.coalesce("error", F.when(F.col("finished").isNull(), F.lit("no result"))).alias("error"),
        *[F.when(ok, F.col(c)).alias(c) for c in carry],
    )


def with_ex_fallback(
    spark: SparkSession, results: DataFrame, databases: DataFrame, **limits
) -> DataFrame:
    """Add ``ex_fallback``: ``ex``, or where nothing was committed the match of the fallback.

    ``results`` has (db_id, gold_sql, final_sql, fallback_sql, ex).
    """
    open_ = results.filter(
        F.col("final_sql").isNull() & (F.coalesce("fallback_sql", F.lit("")) != "")
    )
    pairs = open_.select("db_id", "gold_sql", F.col("fallback_sql").alias("pred_sql")).distinct()
    matched = match_batch(spark, pairs, databases, **limits).select(
        "db_id", "gold_sql", F.col("pred_sql").alias("fallback_sql"), F.col("ex").alias("fallback_ex")
    )
    rescored = F.when(
        F.col("final_sql").isNull() & is_select(F.col("fallback_sql")), F.coalesce("fallback_ex", "ex")
    ).otherwise(F.col("ex"))
    return left_join_skewed(results, matched, ["db_id", "gold_sql", "fallback_sql"]).select(
        *results.columns, rescored.alias("ex_fallback")
    )
