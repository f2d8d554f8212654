"""Transcript outcomes over conversations read as tool-use rollouts."""

from pyspark.sql import functions as F

from queryscore.operators import rewards
from queryscore.operators import transcripts as tr
from queryscore.operators.metrics import summarize
from queryscore.plans.evaluation import evaluate, evaluate_single_turn
from queryscore.plans.training import score_step
from queryscore.scratch import materialise
from registered import query, table
from registered.execution import same_rows, tpch

_GOLD = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"
_ANSWERS = [
    _GOLD + " ORDER BY o_orderkey DESC",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "SELECT nothing FROM orders",
    "SELECT DISTINCT o.o_orderkey FROM orders o WHERE o.o_orderstatus IN ('F')",
]


def _answer(index):
    return F.element_at(F.array(*map(F.lit, _ANSWERS)), (index % 4 + 1).cast("int"))


def _turns(spark, sf_dir):
    """Messages with a final query in some turns and tool calls in others."""
    conv, turn = F.col("conv_id"), F.col("turn")
    call = lambda i, name, args: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), args.alias("arguments"))
    kind = (conv * 7 + turn) % 4
    calls = (
        F.when(kind == 0, F.array(
            call("a", "describe_table", F.lit('{"table": "orders", "sample_rows": 3}')),
            call("b", "run_sql", F.to_json(F.struct(_answer(conv + turn).alias("query")))),
            call("c", "run_sql", F.lit("{}"))))
        .when(kind == 1, F.array(call("a", "run_sql", F.lit("not json")), call("b", "frobnicate", F.lit(None).cast("string"))))
        .when(kind == 2, F.array(call("a", "describe_table", F.lit("{}")), call("b", "list_tables", F.lit(None).cast("string"))))
    )
    content = F.when((conv + turn) % 5 == 0, F.concat("text", F.lit("\nFINAL SQL: "), _answer(conv), F.lit(";"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        conv.alias("rollout_id"), "turn", "role", content.alias("content"), calls.alias("tool_calls")
    )


def _outcome_sql(cap, single):
    """Rollout outcomes in SQL: number the assistant turns, find the end, look back."""
    ends = "final IS NOT NULL" + (" OR kind IN (0, 1)" if single else "")
    answers = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in _ANSWERS) + "]"
    return f"""
a AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 4 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
    CASE WHEN (conv_id + turn) % 5 = 0 THEN {answers}[conv_id % 4 + 1] END AS final, {answers}[(conv_id + turn) % 4 + 1] AS called
    FROM conversations WHERE role = 'assistant'),
c AS (SELECT * FROM a WHERE n <= {cap}),
e AS (SELECT conv_id, min(n) FILTER ({ends}) AS end_n FROM c GROUP BY conv_id),
k AS (SELECT c.*, end_n FROM c JOIN e USING (conv_id) WHERE end_n IS NULL OR n <= end_n),
o AS (SELECT conv_id, max(CASE WHEN n = end_n THEN {"coalesce(final, CASE WHEN kind = 0 THEN called END)" if single else "final"} END) AS final_sql,
    max(end_n) IS NOT NULL AS finished, CAST(count(*) AS INT) AS turns,
    coalesce(bool_or(final IS NULL AND kind IN (0, 2)), false) AS called_describe,
    arg_max(called, n) FILTER (final IS NULL AND kind = 0) AS fallback_sql FROM k GROUP BY conv_id),
rollouts AS (SELECT i.conv_id AS rollout_id, final_sql, coalesce(finished, false) AS finished, coalesce(turns, 0) AS turns,
    coalesce(called_describe, false) AS called_describe, fallback_sql
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN o USING (conv_id))"""


@query(f"WITH {_outcome_sql(3, False)} SELECT * FROM rollouts")
def rollout_outcome(spark, sf_dir):
    return tr.rollout_outcome(_turns(spark, sf_dir), max_turns=3)


@query(f"WITH {_outcome_sql(8, True)} SELECT * FROM rollouts")
def single_shot_outcome(spark, sf_dir):
    return tr.rollout_outcome(_turns(spark, sf_dir), single_shot=True)


@query(f"WITH {_outcome_sql(8, False)} SELECT rollout_id, fallback_sql FROM rollouts")
def fallback_last_call(spark, sf_dir):
    return tr.fallback_sql(_turns(spark, sf_dir))


@query(f"""WITH {_outcome_sql(8, False)},
calls AS (SELECT conv_id, turn, kind, called, unnest([0, 1, 2]) AS call_pos FROM k WHERE final IS NULL AND kind < 3)
SELECT conv_id AS rollout_id, turn, call_pos,
    CASE kind WHEN 0 THEN ['describe_table', 'run_sql', 'run_sql'][call_pos + 1] WHEN 1 THEN ['run_sql', 'frobnicate'][call_pos + 1]
        ELSE ['describe_table', 'list_tables'][call_pos + 1] END AS name,
    CASE WHEN kind = 0 AND call_pos = 1 THEN called END AS query,
    CASE WHEN kind = 0 AND call_pos = 2 OR kind = 1 AND call_pos = 0 THEN 'missing argument ''query''' WHEN kind = 1 THEN 'unknown tool ''frobnicate'''
        WHEN kind = 2 AND call_pos = 0 THEN 'missing argument ''table''' END AS error
FROM calls WHERE kind = 0 OR call_pos < 2""")
def tool_call_log(spark, sf_dir):
    log = tr.tool_call_log(_turns(spark, sf_dir))
    return log.select("rollout_id", "turn", "call_pos", "name", F.col("args")["query"].alias("query"), "error")


@query("""SELECT doc_id AS qid, source AS db_id,
    CASE WHEN toxic = 0 THEN 'SELECT ' || doc_id END AS final_sql, CASE WHEN toxic = 0 THEN quality ELSE 0 END AS ex,
    CAST(CASE WHEN toxic = 0 THEN quality * 7 ELSE 0 END AS DOUBLE) AS reward, CASE WHEN toxic = 0 THEN 3 ELSE 0 END AS turns,
    coalesce(toxic = 0, false) AS finished,
    CASE WHEN toxic = 0 THEN NULL WHEN toxic = 1 THEN substring(text, 1, 200) ELSE 'no result' END AS error
FROM documents LEFT JOIN labels USING (doc_id)""")
def complete_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    failed = table(spark, sf_dir, "labels").join(docs.select("doc_id", "text"), "doc_id")
    results = failed.select(
        F.col("doc_id").alias("qid"), F.concat(F.lit("SELECT "), F.col("doc_id").cast("string")).alias("final_sql"),
        F.col("quality").alias("ex"), (F.col("quality") * 7.0).alias("reward"), F.lit(3).alias("turns"),
        F.lit(True).alias("finished"), F.when(F.col("toxic") == 1, F.col("text")).alias("error"),
    )
    questions = docs.select(F.col("doc_id").alias("qid"), F.col("source").alias("db_id"))
    return tr.complete_results(questions, results)


def _is_match(column):
    """SQL: 1 where a text is one of the answers that equal the gold result."""
    cases = " ".join(
        "WHEN {} = '{}' THEN {}".format(column, a.replace("'", "''"), "0" if i == 2 else f"(SELECT {same_rows(a, _GOLD)}::INT)")
        for i, a in enumerate(_ANSWERS)
    )
    return f"CASE {cases} ELSE 0 END"


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid")).distinct().select(
        "qid", F.lit("tpch").alias("db_id"), F.lit("finished orders?").alias("question"), F.lit(_GOLD).alias("gold_sql")
    )


_EVALUATED = f"""evaluated AS (SELECT rollout_id AS qid, final_sql, {_is_match('final_sql')} AS ex, finished, turns,
    {_is_match('coalesce(final_sql, fallback_sql)')} AS ex_fallback FROM rollouts)"""


@query(f"WITH {_outcome_sql(3, False)}, {_EVALUATED} SELECT * FROM evaluated")
def evaluation_results(spark, sf_dir):
    out = evaluate(spark, _turns(spark, sf_dir), _questions(spark, sf_dir), tpch(spark, sf_dir), "r1", max_turns=3)
    return out.select("qid", "final_sql", "ex", "finished", "turns", "ex_fallback")


@query(f"WITH {_outcome_sql(3, False)}, {_EVALUATED} SELECT qid, ex, ex_fallback FROM evaluated")
def ex_fallback(spark, sf_dir):
    databases = tpch(spark, sf_dir)
    rollouts = tr.rollout_outcome(_turns(spark, sf_dir), max_turns=3)
    results = rollouts.select(
        F.col("rollout_id").alias("qid"), "final_sql", "fallback_sql", F.lit("tpch").alias("db_id"),
        F.lit(_GOLD).alias("gold_sql"), F.col("final_sql").alias("pred_sql"),
    )
    scored = materialise(rewards.score_pairs(spark, materialise(results, "rollouts"), databases, "r1"), "scored")
    return tr.with_ex_fallback(spark, scored, databases).select("qid", "ex", "ex_fallback")


@query(f"""WITH {_outcome_sql(3, False)}, {_EVALUATED}
SELECT qid, CASE WHEN qid % 3 <> 0 THEN final_sql END AS final_sql, CASE WHEN qid % 3 = 0 THEN 0 ELSE ex END AS ex, qid % 3 <> 0 AND finished AS finished,
    CASE WHEN qid % 3 = 0 THEN 'lost ' || qid END AS error FROM evaluated""")
def evaluation_with_failed_rollouts(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    failed = questions.where("qid % 3 = 0").select("qid", F.concat(F.lit("lost "), F.col("qid").cast("string")).alias("error"))
    out = evaluate(spark, _turns(spark, sf_dir), questions, tpch(spark, sf_dir), "r1", max_turns=3, failed=failed)
    return out.select("qid", "final_sql", "ex", "finished", "error")


@query("""SELECT c_custkey AS qid, CASE c_custkey % 4 WHEN 0 THEN 'SELECT count(*) FROM nation WHERE n_regionkey = ' || c_custkey % 5 WHEN 1 THEN 'VALUES (5)' END AS final_sql,
    CASE c_custkey % 4 WHEN 0 THEN ((SELECT count(*) FROM nation WHERE n_regionkey = c_custkey % 5) = (SELECT count(*) FROM region))::INT
        WHEN 1 THEN ((SELECT count(*) FROM region) = 5)::INT ELSE 0 END AS ex,
    c_custkey % 4 < 2 AS finished, CASE c_custkey % 4 WHEN 3 THEN 'no result' END AS error FROM customer""")
def evaluation_single_turn(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("qid"), F.lit("tpch").alias("db_id"), F.lit("SELECT count(*) FROM region").alias("gold_sql"))
    said = F.when(key % 4 == 0, F.concat(F.lit("Well.\nFINAL SQL: SELECT count(*) FROM nation WHERE n_regionkey = "), (key % 5).cast("string"))).when(
        key % 4 == 1, F.lit("FINAL SQL: VALUES (5)")).otherwise(F.lit("I cannot tell."))
    completions = table(spark, sf_dir, "customer").where(key % 4 != 3).select(key.alias("qid"), said.alias("completion"))
    return evaluate_single_turn(spark, completions, rows, tpch(spark, sf_dir)).select("qid", "final_sql", "ex", "finished", "error")


@query(f"""WITH {_outcome_sql(8, False)}, {_EVALUATED}
SELECT count(*) AS n, round(avg(ex), 6) AS ex_rate, round(avg(ex_fallback), 6) AS ex_rate_fallback, round(avg(ex), 6) AS mean_reward,
    round(avg(finished::INT), 6) AS finished_rate, round(avg((final_sql IS NOT NULL)::INT), 6) AS valid_sql_rate,
    round(avg(turns), 6) AS avg_turns FROM evaluated""")
def evaluation_summary(spark, sf_dir):
    out = summarize(evaluate(spark, _turns(spark, sf_dir), _questions(spark, sf_dir), tpch(spark, sf_dir), "r1"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query(f"WITH {_outcome_sql(8, True)} SELECT rollout_id AS qid, CAST({_is_match('final_sql')} AS DOUBLE) AS reward FROM rollouts")
def reward_s0(spark, sf_dir):
    rollouts = tr.rollout_outcome(_turns(spark, sf_dir), single_shot=True)
    pairs = rollouts.select(
        F.col("rollout_id").alias("qid"), F.col("final_sql").alias("pred_sql"), F.lit("tpch").alias("db_id"),
        F.lit(_GOLD).alias("gold_sql"),
    )
    databases = tpch(spark, sf_dir)
    return rewards.score_pairs(spark, materialise(pairs, "pairs"), databases, "s0").select("qid", "reward")


def _completions(spark, sf_dir):
    """Every message as one sampled completion of its conversation's question."""
    answer = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("\nFINAL SQL: "), _answer(F.col("conv_id") + F.col("turn")))).otherwise("")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("qid"), F.col("turn"), (F.col("conv_id") % 10).alias("step"),
        F.concat("text", answer).alias("completion"),
    )


_SAMPLED = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in _ANSWERS) + "][(conv_id + turn) % 4 + 1]"
_REWARDED = f"""rewarded AS (SELECT conv_id AS qid, turn, conv_id % 10 AS step,
    CASE WHEN turn % 2 = 1 THEN {_is_match(_SAMPLED)} ELSE 0 END AS ex FROM conversations)"""


@query(f"WITH {_REWARDED} SELECT qid, turn, ex, CAST(ex AS DOUBLE) AS reward FROM rewarded")
def completion_rewards(spark, sf_dir):
    out = rewards.score_completions(spark, _completions(spark, sf_dir), _questions(spark, sf_dir), tpch(spark, sf_dir), "r1")
    return out.select("qid", "turn", "ex", "reward")


@query(f"""WITH {_REWARDED}, g AS (SELECT qid, avg(ex) AS mean, stddev_samp(ex) AS sd FROM rewarded GROUP BY qid)
SELECT qid, turn, round(CASE WHEN sd > 0 THEN (ex - mean) / sd ELSE 0 END, 6) AS advantage FROM rewarded JOIN g USING (qid)""")
def training_step_advantages(spark, sf_dir):
    rewarded, _ = score_step(spark, _completions(spark, sf_dir), _questions(spark, sf_dir), tpch(spark, sf_dir), "r1")
    return rewarded.select("qid", "turn", F.round("advantage", 6).alias("advantage"))
