import json
import random

import pytest

from queryscore.sources import json_array, records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


HOSTILE = ["}", "{", "},{", '"}', '\\"', "\\", "\\\\", "]}", '{"a": [1, {"b": "}"}]}', "é}ü", "\n}\n", "", "},\n  {", '"' * 5, "x" * 700 + "}" + "y" * 700, "\x1f}"]


def _records(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(HOSTILE) for _ in range(rng.randrange(4)))
    return [{"db_id": f"d{i}", "question": text(), "evidence": text(), "gold_sql": text(), "extra": [{"k": [text(), {"z": {}}]}]} for i in range(n)]


@pytest.mark.parametrize("layout", [{}, {"separators": (",", ":")}, {"indent": 3}, {"ensure_ascii": False, "separators": (" ,\n ", " : ")}])
def test_one_file_many_tasks_equals_the_whole(spark, tmp_path, small_splits, layout):
    rows = _records(150)
    (tmp_path / "a.json").write_text(json.dumps(rows, **layout) + "\n", encoding="utf-8")
    found = json_array.elements(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 20
    got = sorted(found.collect(), key=lambda r: r.pos)
    assert [json.loads(r.value) for r in got] == rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file") >= 1 and "Exchange RoundRobin" not in plan


def test_numbered_questions_over_files(spark, tmp_path, small_splits):
    parts = [_records(40, 2), [], _records(1, 3), _records(30, 4)]
    for k, rows in enumerate(parts):
        (tmp_path / f"{k}.json").write_text(json.dumps(rows))
    every = [r for rows in parts for r in rows]
    got = records.read_questions(spark, str(tmp_path), "/x", layout="array").orderBy("qid").collect()
    assert [(r.qid, r.question, r.gold_sql, r.evidence) for r in got] == [(i, r["question"], r["gold_sql"], r["evidence"]) for i, r in enumerate(every)]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": 2', '[{"a": 1}', '{"a": 1}\n', '[{"a": "x]'])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="JSON array"):
        json_array.elements(spark, str(tmp_path)).collect()


def test_state_behind_a_piece():
    assert json_array.after('[{"a": "', False, 0) == (True, 2)
    assert json_array.after('x", "b": {"c": 1', True, 2) == (False, 2)
    assert json_array.after('\\\\" , "', True, 5) == (True, 5)
    assert json_array.after("]", False, 1) == (False, -1)
