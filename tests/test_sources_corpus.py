import json
import random

import pytest
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.operators import corpus as c
from queryscore.operators import filters as f
from queryscore.plans.preparation import open_databases, training_corpus, usable_questions
from queryscore.plans.training import score_step
from queryscore.sources import database as db
from queryscore.sources import records as rec
from tests.conftest import GOLD


def test_read_questions_layouts(spark, tmp_path):
    raw = [
        {"db_id": "marina", "question": "a", "SQL": "S1", "query": "x", "difficulty": "simple", "evidence": None},
        {"db_id": "marina", "question": "b", "SQL": "", "query": "S2"},
        {"db_id": "quarry", "question": "c", "gold_sql": "S3", "difficulty": "challenging"},
        {"db_id": "quarry", "question": "d } ,\n {"},
    ]
    files = {
        "jsonl": "\n\n".join(json.dumps(r) for r in raw) + "\n",
        "array": json.dumps(raw),
        "indented": json.dumps(raw, indent=2) + "\n",
    }
    for layout, text in files.items():
        path = tmp_path / f"q-{layout}.json"
        path.write_text(text)
        rows = rec.read_questions(spark, str(path), "/root/dbs/", layout).orderBy("qid").collect()
        assert [r.qid for r in rows] == list(range(len(raw)))
        assert [r.question for r in rows] == ["a", "b", "c", "d } ,\n {"]
        assert [r.gold_sql for r in rows] == ["S1", "S2", "S3", ""]
        assert [r.difficulty for r in rows] == ["simple", "", "challenging", ""]
        assert rows[0].db_path == "/root/dbs/marina" and rows[0].evidence == ""
    qs = rec.read_questions(spark, str(tmp_path / "q-jsonl.json"), "/dbs")
    assert f.filter_difficulty(qs, {"challenging"}).count() == 1
    assert f.filter_difficulty(qs, {""}).count() == 2
    assert f.filter_difficulty(qs, None).count() == 4
    assert [r.question for r in f.head_n(qs, 2, "qid").orderBy("qid").collect()] == ["a", "b"]
    assert f.head_n(qs, 0, "qid").count() == 4


def test_missing_required_key_and_bad_json_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"db_id": "x"}\n')
    (tmp_path / "b.json").write_text('{"db_id": \n')
    for name in ("a.json", "b.json"):
        with pytest.raises(Exception):
            rec.read_questions(spark, str(tmp_path / name), "/dbs").collect()


def test_file_order_survives_many_splits(spark, tmp_path):
    rng = random.Random(4)
    raw = [{"db_id": f"d{i}", "sql_complexity": "Simple", "question": "q" * rng.randint(1, 90), "cot": '}, {"\n  {'} for i in range(3000)]
    (tmp_path / "s.json").write_text(json.dumps(raw, indent=2))
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in raw))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name, layout in (("s.jsonl", "jsonl"), ("s.json", "indented")):
            df = rec.read_synth(spark, str(tmp_path / name), layout)
            assert spark.read.text(str(tmp_path / name)).rdd.getNumPartitions() > 4
            rows = df.orderBy("pos").collect()
            assert [r.db_id for r in rows] == [f"d{i}" for i in range(3000)]
            assert rows[5].cot == '}, {"\n  {' and len({r.pos for r in rows}) == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ddl_last_wins_and_results_round_trip(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([
        {"db_id": "a", "ddls": ["CREATE 1", "CREATE 2"]}, {"db_id": "b"}, {"db_id": "a", "ddls": ["CREATE 3"]}]))
    got = {r.db_id: r.schema for r in rec.read_ddl(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"a": "CREATE 3", "b": ""}
    results = spark.createDataFrame(
        [("marina", None, 1, 7.0, (None, 1), 3, True), ("marina", "SELECT 1", 0, 2.5, (1, None), 1, None)],
        "db_id string, final_sql string, ex int, reward double, breakdown struct<ex_fallback:int,ex:int>, turns int, finished boolean")
    rec.write_jsonl(results.coalesce(1), str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("part*") for x in p.read_text().splitlines()]
    assert "final_sql" in lines[0] and lines[0]["final_sql"] is None
    back = rec.read_results(spark, str(tmp_path / "r")).orderBy("pos").collect()
    assert [(r.ex, r.ex_fallback, r.reward) for r in back] == [(1, 1, 7.0), (0, 1, 2.5)]


def test_catalog_texts(spark, marina, marina_columns, db_root):
    assert db.list_tables(marina_columns).first().text == "Tables: boats, moorings"
    text = db.schema_text(marina_columns).first().schema
    assert text == (
        "CREATE TABLE boats (hull BIGINT, title STRING, harbour STRING)\n"
        "CREATE TABLE moorings (slip BIGINT, berth BIGINT, fee DOUBLE)")
    order = {"boats": ["hull"], "moorings": ["slip"]}
    texts = db.describe_tables(marina_columns, db.table_samples(spark, "marina", marina["marina"], order_by=order))
    asked = spark.createDataFrame([("marina", "boats"), ("marina", "Boats"), ("marina", "boats') UNION SELECT 1,2--")], "db_id string, table_name string")
    got = {r.table_name: r.text for r in db.describe_requests(asked, texts).collect()}
    assert got["boats"] == (
        "Table boats:\ncolumns: hull BIGINT, title STRING, harbour STRING\nsample:\n"
        "('1', 'Alba', 'Oslo')\n('2', 'Brisa', 'Riga')\n('3', 'Cirrus', 'Oslo')")
    assert got["Boats"] == "Error: no such table: Boats"
    assert got["boats') UNION SELECT 1,2--"].startswith("Error: no such table")
    assert {r.db_id for r in db.find_databases(spark, db_root).collect()} == {"marina", "quarry"}


QUESTION = "qid long, db_id string, question string, gold_sql string, db_path string, evidence string, difficulty string"


def questions_df(spark):
    return spark.createDataFrame(
        [(0, "marina", "titles in Oslo?", GOLD, "/d/marina", "ev", "simple"),
         (1, "marina", "spend?", "SELECT sum(fee) FROM MOORINGS o JOIN Boats c ON o.berth = c.hull", "/d/marina", "", "hard"),
         (2, "marina", "one?", "SELECT 1", "/d/marina", "", ""), (3, "marina", "none?", "", "/d/marina", "", ""),
         (4, "lost", "lost?", "SELECT 1", "/d/lost", "", "")], QUESTION)


def test_prompts_and_sft(spark, databases, marina_columns):
    qs = questions_df(spark)
    row = c.grpo_dataset(qs).filter("qid = 0").first()
    assert [(x.role, x.content) for x in row.prompt] == [
        ("system", fv.SYSTEM_PROMPT), ("user", "Question: titles in Oslo?\nDatabase: marina\nEvidence: ev")]
    schemas = db.schema_text(marina_columns)
    sft = {r.qid: r.messages for r in c.sft_examples(qs, schemas, databases).collect()}
    assert set(sft) == {0, 1, 2}
    assert [x.role for x in sft[0]] == ["system", "user", "assistant"]
    assert sft[0][2].content == "FINAL SQL: " + GOLD and "CREATE TABLE boats" in sft[0][1].content
    assert sft[0][1].content.endswith("\n\nQuestion: titles in Oslo?\nEvidence: ev")
    single = {r.qid: r.messages for r in c.singleturn_prompts(qs, schemas).collect()}
    assert len(single[0]) == 2 and single[4][1].content == "Schema:\n\n\nQuestion: lost?"
    synth = spark.createDataFrame(
        [(0, "marina", "q?", "ev", "step 1", "SELECT a FROM t"), (1, "no", "q?", None, None, "SELECT 2")],
        "pos long, db_id string, question string, external_knowledge string, cot string, sql string")
    ddl = spark.createDataFrame([("marina", "CREATE TABLE t(a INT)")], "db_id string, schema string")
    made = {r.pos: r.messages for r in c.synth_to_sft(synth, ddl).collect()}
    assert made[0][2].content == "step 1\nFINAL SQL: SELECT a FROM t"
    assert made[0][1].content == "Schema:\nCREATE TABLE t(a INT)\n\nQuestion: q?\nEvidence: ev"
    assert made[1][2].content == "FINAL SQL: SELECT 2" and made[1][1].content == "Schema:\n\n\nQuestion: q?"
    mixed = c.mix_corpora(gold=c.sft_examples(qs, schemas, databases), synth=c.synth_to_sft(synth, ddl), other=None)
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == {"gold": 3, "synth": 2}


def test_gold_tables_and_trajectories(spark, db_root, databases):
    qs = questions_df(spark)
    columns, texts = open_databases(spark, {"marina": f"{db_root}/marina"})
    got = {r.qid: r.tables for r in c.gold_tables(qs, columns).collect()}
    assert got[0] == ["boats"] and got[1] == ["moorings", "boats"] and got[2] == ["boats", "moorings"]
    made = {r.qid: r.messages for r in c.agentic_trajectories(qs, databases, columns, texts).collect()}
    assert set(made) == {0, 1, 2}
    roles = [x.role for x in made[1]]
    assert roles == ["system", "user", "assistant", "tool", "assistant", "tool", "tool", "assistant"]
    assert [(t.id, t.name, t.arguments) for t in made[1][4].tool_calls] == [
        ("call_2", "describe_table", '{"table":"moorings"}'), ("call_3", "describe_table", '{"table":"boats"}')]
    assert made[1][3].content == "Tables: boats, moorings" and made[1][3].tool_call_id == "call_1"
    assert made[1][5].content.startswith("Table moorings:\ncolumns: slip BIGINT") and made[1][6].tool_call_id == "call_3"
    assert made[0][-1].content == "FINAL SQL: " + GOLD
    counts = c.written_and_skipped(qs, c.agentic_trajectories(qs, databases, columns, texts)).first()
    assert tuple(counts) == (3, 2)
    assert [r.db_id for r in f.missing_databases(qs, databases).collect()] == ["lost"]
    mixed = training_corpus(qs, databases, columns, texts)
    assert mixed.groupBy("source").count().count() == 2


def test_preparation_and_training_plans(spark, databases):
    qs = questions_df(spark)
    verdicts = {r.qid: r.reason for r in usable_questions(spark, qs, databases).collect()}
    assert verdicts == {0: "ok", 1: "ok", 2: "ok", 3: "empty_sql", 4: "no_db"}
    comps = spark.createDataFrame(
        [(1, 0, f"FINAL SQL: {GOLD}"), (1, 0, "none"), (1, 2, "FINAL SQL: SELECT 1"), (1, 2, "FINAL SQL: SELECT 1")],
        "step int, qid long, completion string")
    rewards, density = score_step(spark, comps, qs, databases, "r1")
    assert sorted(round(r.advantage, 4) for r in rewards.collect()) == [-0.7071, 0.0, 0.0, 0.7071]
    assert density.first().density == 0.5


def brute_stratified(rows, total):
    per, seen, out = max(1, total // 4), {}, []
    for pos, key in rows:
        key = "_" if key is None else key
        if seen.get(key, 0) < per:
            seen[key] = seen.get(key, 0) + 1
            out.append(pos)
            if len(out) >= total:
                break
    return out


@pytest.mark.parametrize("total,kinds", [(40, 3), (40, 9), (3, 5), (1000, 2)])
def test_stratified_head_matches_brute_force(spark, total, kinds):
    rng = random.Random(total + kinds)
    rows = [(i * 3, rng.choice(["hot"] * 5 + [f"k{j}" for j in range(kinds)] + [None])) for i in range(700)]
    df = spark.createDataFrame(rows, "pos long, kind string").repartition(5)
    got = sorted(r.pos for r in c.stratified_head(df, "kind", total, "pos").collect())
    assert got == brute_stratified(rows, total)


@pytest.mark.parametrize("layout", ["jsonl", "array", "indented"])
def test_numbers_run_on_over_several_files(spark, tmp_path, layout):
    folder = tmp_path / layout
    folder.mkdir()
    for k in range(3):
        rows = [{"db_id": "d", "question": f"q{10 * k + i}", "SQL": "SELECT 1"} for i in range(10)]
        text = "\n\n".join(map(json.dumps, rows)) if layout == "jsonl" else json.dumps(rows, indent={"indented": 2, "array": k}.get(layout))
        (folder / f"{k}.json").write_text(text)
    rows = rec.read_questions(spark, str(folder), "/d", layout).collect()
    assert sorted((r.qid, r.question) for r in rows) == [(i, f"q{i}") for i in range(30)]


def test_readers_scan_once_and_shuffle_nothing(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"db_id": "d", "question": "q"}) + "\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rec.read_synth(spark, str(tmp_path / "s.jsonl"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
        # numbering moves one row per split and no text
        plan = rec.read_questions(spark, str(tmp_path / "s.jsonl"), "/d")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_questions_that_cannot_be_told_are_skipped_and_counted(spark):
    questions = spark.createDataFrame(
        [(0, "a", "SELECT x FROM t"), (1, "empty", "SELECT 1"), (2, "a", ""), (3, "gone", "SELECT 1"), (4, "a", "SELECT 1")],
        "qid int, db_id string, gold_sql string",
    ).withColumns({"question": F.lit("q"), "evidence": F.lit("")})
    databases = spark.createDataFrame([("a",), ("empty",)], "db_id string")
    columns = spark.createDataFrame([("a", "T", 0, "x", "INT"), ("a", "t", 0, "x", "INT")], db.COLUMNS_SCHEMA)
    texts = spark.createDataFrame([("a", "T", "Table T"), ("a", "t", "Table t")], "db_id string, table_name string, text string")
    made = c.agentic_trajectories(questions, databases, columns, texts)
    rows = {r.qid: r.messages for r in made.collect()}
    assert rows.keys() == {0, 4} and all(m is not None for ms in rows.values() for m in ms)
    assert tuple(c.written_and_skipped(questions, made).first()) == (2, 3)
    assert {r.db_id: r.text for r in db.list_tables(columns, databases).collect()} == {"a": "Tables: T, t", "empty": "No tables."}


def test_open_databases_gathers_all_in_two_tables(spark, db_root):
    from queryscore.plans.preparation import open_databases

    columns, texts = open_databases(spark, {"marina": f"{db_root}/marina", "quarry": f"{db_root}/quarry"})
    assert {(r.db_id, r.table_name) for r in texts.collect()} == {("marina", "boats"), ("marina", "moorings"), ("quarry", "boats")}
    assert columns.count() == 8 and "Union" not in texts._jdf.queryExecution().analyzed().toString()
    none = open_databases(spark, {})
    assert [t.count() for t in none] == [0, 0]
