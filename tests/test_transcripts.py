import json
import random

from pyspark.sql import functions as F

from queryscore.functions.messages import TOOL_CALL
from queryscore.operators import transcripts as tr
from queryscore.plans.evaluation import evaluate
from tests.conftest import GOLD

SCHEMA = f"rollout_id string, turn int, role string, content string, tool_calls array<{TOOL_CALL}>"


def tool(name, args):
    return ("assistant", None, [("c", name, args if isinstance(args, (str, type(None))) else json.dumps(args))])


def say(text, role="assistant"):
    return (role, text, None)


def turns_df(spark, scripts):
    rows = [(rid, i, *m) for rid, ms in scripts.items() for i, m in enumerate(ms)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


SCRIPTS = {
    "done": [say("sys", "system"), say("q FINAL SQL: no", "user"), tool("describe_table", {"table": "boats"}), say("r", "tool"),
             tool("run_sql", {"query": "SELECT 1"}), say("r", "tool"), say("FINAL SQL: SELECT 2"), tool("run_sql", {"query": "later"})],
    "talk": [say("hm"), say("go on", "user"), say("hm"), say("hm"), say("FINAL SQL: too late")],
    "fall": [tool("run_sql", {"query": "SELECT a"}), tool("run_sql", {"query": ""}), tool("run_sql", "not json"), say("x")],
    "none": [say("only the question", "user")],
    "both": [("assistant", "FINAL SQL: SELECT f", [("c", "run_sql", '{"query":"SELECT r"}')])],
    "noq": [("assistant", None, [("a", "describe_table", '{"table":"t"}'), ("b", "run_sql", "{}"), ("c", "describe_table", None)])],
    "odd": [tool("frobnicate", {}), tool("describe_table", {}), tool("list_tables", None), tool("run_sql", {"query": None})],
}


def outcomes(spark, **kw):
    return {r.rollout_id: r for r in tr.rollout_outcome(turns_df(spark, SCRIPTS), **kw).collect()}


def test_rollout_outcome(spark):
    got = outcomes(spark, max_turns=3)
    view = {k: (r.final_sql, r.finished, r.turns, r.fallback_sql, r.called_describe) for k, r in got.items()}
    assert view == {
        "done": ("SELECT 2", True, 3, "SELECT 1", True),
        "talk": (None, False, 3, None, False),
        "fall": (None, False, 3, "SELECT a", False),
        "none": (None, False, 0, None, False),
        "both": ("SELECT f", True, 1, None, False),
        "noq": (None, False, 1, None, True),
        "odd": (None, False, 3, None, True),
    }
    assert outcomes(spark)["talk"].final_sql == "too late"


def test_single_shot(spark):
    got = outcomes(spark, single_shot=True)
    view = {k: (r.final_sql, r.finished, r.turns, r.fallback_sql) for k, r in got.items()}
    assert view["done"] == ("SELECT 1", True, 2, "SELECT 1")
    assert view["fall"] == ("SELECT a", True, 1, "SELECT a")
    assert view["both"] == ("SELECT f", True, 1, None)
    assert view["noq"] == (None, True, 1, None)
    assert view["talk"][:2] == ("too late", True)


def test_tool_call_log(spark):
    log = tr.tool_call_log(turns_df(spark, SCRIPTS), max_turns=8)
    rows = {(r.rollout_id, r.turn, r.call_pos): r for r in log.collect()}
    assert [rows["odd", i, 0].error for i in range(4)] == ["unknown tool 'frobnicate'", "missing argument 'table'", None, None]
    assert rows["fall", 2, 0].error == "missing argument 'query'" and rows["fall", 2, 0]["args"] == {}
    assert ("done", 2, 0) in rows and ("done", 7, 0) not in rows and ("both", 0, 0) not in rows
    assert ("noq", 0, 2) in rows
    short = tr.tool_call_log(turns_df(spark, SCRIPTS), single_shot=True)
    assert {r.call_pos for r in short.filter("rollout_id = 'noq'").collect()} == {0, 1}


def test_hot_rollout_is_trimmed_before_the_shuffle(spark):
    plan = tr.rollout_outcome(turns_df(spark, SCRIPTS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.count("hashpartitioning(rollout_id") == 1


def test_complete_results(spark):
    questions = spark.createDataFrame([(i, "marina", f"q{i}") for i in range(3)], "qid long, db_id string, question string")
    results = spark.createDataFrame(
        [(0, "SELECT 1", 1, 1.0, 2, True, None), (1, "x", 1, 1.0, 2, True, "E" * 300)],
        "qid long, final_sql string, ex int, reward double, turns int, finished boolean, error string",
    )
    rows = tr.complete_results(questions, results).orderBy("qid").collect()
    assert [(r.final_sql, r.ex, r.reward, r.turns, r.finished) for r in rows] == [
        ("SELECT 1", 1, 1.0, 2, True), (None, 0, 0.0, 0, False), (None, 0, 0.0, 0, False)]
    assert [r.error for r in rows] == [None, "E" * 200, "no result"]


def test_evaluate_end_to_end(spark, databases):
    scripts = {
        0: [tool("list_tables", {}), say(f"FINAL SQL: {GOLD}")],
        1: [tool("run_sql", {"query": GOLD}), say("hm"), say("hm")],
        2: [say("FINAL SQL: SELECT title FROM boats")],
    }
    rows = [(rid, i, *m) for rid, ms in scripts.items() for i, m in enumerate(ms)]
    turns = spark.createDataFrame(rows, SCHEMA.replace("rollout_id string", "rollout_id long"))
    questions = spark.createDataFrame([(i, "marina", "q", GOLD) for i in range(4)], "qid long, db_id string, question string, gold_sql string")
    got = evaluate(spark, turns, questions, databases, "r1", max_turns=3).orderBy("qid").collect()
    assert [(r.ex, r.reward, r.ex_fallback, r.finished, r.turns) for r in got] == [
        (1, 1.0, 1, True, 2), (0, 0.0, 1, False, 3), (0, 0.0, 0, True, 1), (0, 0.0, 0, False, 0)]
    assert got[3].error == "no result"
    s0 = evaluate(spark, turns, questions, databases, "s0").orderBy("qid").collect()
    assert [r.ex for r in s0] == [1, 1, 0, 0]


def test_of_a_repeated_argument_the_last_counts(spark):
    from queryscore.operators.transcripts import call_args

    texts = ['{"query": "a", "x": 1, "query": "b"}', '{"table": "t"}', None, "[", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", call_args(F.col("t")).alias("a")).collect()}
    assert got == {0: {"query": "b", "x": "1"}, 1: {"table": "t"}, 2: {}, 3: {}, 4: {}}
