import pytest

from queryscore.operators import execution as ex
from queryscore.operators.rewards import reward_r1, reward_r2, reward_r3, score_completions, score_pairs
from pyspark.sql import functions as F

from tests.conftest import GOLD

ALL = "SELECT title FROM boats"


def pairs_df(spark, rows):
    return spark.createDataFrame(
        [(i, "marina", p, g) for i, (p, g) in enumerate(rows)],
        "i int, db_id string, pred_sql string, gold_sql string",
    )


MATCH_CASES = [
    ("SELECT title FROM boats ORDER BY hull", "SELECT title FROM boats ORDER BY title DESC", 1),
    ("SELECT title FROM boats WHERE harbour='Riga'", ALL, 0),
    ("SELECT nope FROM boats", "SELECT 1", 0),
    ("", "SELECT 1", 0),
    (None, "SELECT 1", 0),
    ("CREATE TABLE t(x INT)", "SELECT 1", 0),
    ("DROP VIEW boats", "SELECT 1", 0),
    ("WITH a AS (SELECT 1) DELETE FROM boats", "SELECT 1", 0),
    ("SELECT 1; SELECT 1", "SELECT 1", 0),
    ("SELECT 1;", "SELECT 1", 1),
    ("SELECT NULL", "SELECT NULL", 1),
    ("SELECT NULL", "SELECT 0", 0),
    ("SELECT 1 UNION ALL SELECT 1", "SELECT 1", 1),
    ("SELECT 1", "SELECT 1.0D", 1),
    ("SELECT 1", "SELECT CAST(1 AS DECIMAL(10,2))", 1),
    ("SELECT 1.5", "SELECT 1.5D", 1),
    ("SELECT -0.0D", "SELECT 0", 1),
    ("SELECT true", "SELECT 1", 1),
    ("SELECT '1'", "SELECT 1", 0),
    ("SELECT X'31'", "SELECT '1'", 0),
    ("SELECT DOUBLE('NaN')", "SELECT NULL", 1),
    ("SELECT title, harbour FROM boats", "SELECT harbour, title FROM boats", 0),
    ("SELECT title AS a FROM boats", "SELECT title AS b FROM boats", 1),
    ("SELECT title, title FROM boats", "SELECT title, title FROM boats", 1),
    ("SELECT 1 WHERE false", "SELECT 1, 2 WHERE false", 1),
    ("SELECT 1 WHERE false", "SELECT 1", 0),
    ("SELECT 1", "SELECT 1, 1", 0),
    ("SELECT 1", "SELECT nope", 0),
    ("SELECT 1/0", "SELECT 1/0", 0),
    ("SELECT CAST(9007199254740993 AS BIGINT)", "SELECT CAST(9007199254740993 AS DOUBLE)", 0),
    ("SELECT 'a;b', 'c'", "SELECT 'a', 'b;c'", 0),
    ("SELECT 's1:a;s1:b'", "SELECT 'a', 'b'", 0),
    ("SELECT DATE'2020-01-02'", "SELECT '2020-01-02'", 1),
    ("SELECT DOUBLE('Infinity')", "SELECT 9223372036854775807", 0),
    ("SELECT 1e300D", "SELECT 1e300D", 1),
    ("SELECT CAST(NULL AS INT), 1", "SELECT 1, CAST(NULL AS INT)", 0),
    ("SELECT CAST(1.25 AS DECIMAL(10,3)), 7BD", "SELECT 1.25D, 7", 1),
    ("SELECT CAST(0.25 AS DECIMAL(38,38))", "SELECT 0.25D", 1),
    ("SELECT CAST(1.25 AS DECIMAL(10,3))", "SELECT 1", 0),
    ("SELECT 'ab', 'c'", "SELECT 'a', 'bc'", 0),
    ("SELECT ''", "SELECT NULL", 0),
    ("SELECT id, CAST(id AS DOUBLE) / 3 FROM range(5000)", "SELECT CAST(id AS DOUBLE), id / 3.0D FROM range(4999, -1, -1)", 1),
    ("SELECT ARRAY(1,2)", "SELECT ARRAY(1,2)", 1),
    ("SELECT MAP('a',1,'b',2)", "SELECT MAP('b',2,'a',1)", 1),
]


def test_match_batch_cases(spark, databases):
    out = ex.match_batch(spark, pairs_df(spark, [c[:2] for c in MATCH_CASES]), databases).collect()
    got = {r.i: r.ex for r in out}
    assert len(out) == len(MATCH_CASES)
    for i, case in enumerate(MATCH_CASES):
        assert got[i] == case[2], case


def test_match_statuses_and_write_leaves_tables_alone(spark, databases):
    pairs = pairs_df(spark, [("SELECT nope", "SELECT 1"), ("", "SELECT 1"), ("DROP VIEW boats", ALL), (ALL, ALL)])
    rows = {r.i: r for r in ex.match_batch(spark, pairs, databases).collect()}
    assert [rows[i].pred_status for i in range(4)] == ["exec_error", "empty_sql", "exec_error", "ok"]
    assert rows[3].ex == 1
    no_db = pairs.filter("i = 3").withColumn("db_id", F.lit("none"))
    row = ex.match_batch(spark, no_db, databases).first()
    assert (row.ex, row.pred_status, row.gold_status) == (0, "no_db", "no_db")


def test_databases_with_equal_table_names_stay_apart(spark, databases):
    pairs = spark.createDataFrame(
        [("marina", "SELECT 'Zephyr'", ALL), ("quarry", "SELECT 'Zephyr'", ALL)],
        "db_id string, pred_sql string, gold_sql string",
    )
    got = {r.db_id: r.ex for r in ex.match_batch(spark, pairs, databases).collect()}
    assert got == {"marina": 0, "quarry": 1}


def test_pairwise_match_agrees_with_batch_and_is_symmetric(spark, databases):
    frames = {
        "gold": spark.sql("SELECT id % 7 AS a, CAST(id % 3 AS DOUBLE) AS b FROM range(1000)"),
        "same": spark.sql("SELECT DISTINCT CAST(id % 7 AS DOUBLE) AS x, id % 3 AS y FROM range(500)"),
        "less": spark.sql("SELECT id % 7 AS a, id % 3 AS b FROM range(20)"),
        "none": spark.sql("SELECT id FROM range(0)"),
    }
    expected = {("gold", "same"): 1, ("gold", "less"): 0, ("gold", "none"): 0, ("none", "none"): 1, ("gold", "gold"): 1}
    for (a, b), want in expected.items():
        assert ex.result_set_match(frames[a], frames[b]).first().ex == want
        assert ex.result_set_match(frames[b], frames[a]).first().ex == want


def test_float_digits_option(spark, databases):
    pairs = pairs_df(spark, [("SELECT 0.1D + 0.2D", "SELECT 0.3D")])
    assert ex.match_batch(spark, pairs, databases).first().ex == 0
    assert ex.match_batch(spark, pairs, databases, float_digits=9).first().ex == 1


SLOW = "SELECT count(*) FROM range(4000000000000) WHERE id % 7 = 3 AND sqrt(id) > 1"


def test_timeout_stops_a_runaway_query(spark, databases):
    rows = ex.match_batch(spark, pairs_df(spark, [(SLOW, ALL), (ALL, ALL)]), databases, timeout_s=4).collect()
    got = {r.i: (r.ex, r.pred_status) for r in rows}
    assert got == {0: (0, "timeout"), 1: (1, "ok")}
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_executes_ok(spark, databases):
    texts = ["SELECT 1", "SELECT nope FROM boats", " ", None, "DELETE FROM boats", "WITH a AS (SELECT 1 x) SELECT * FROM a"]
    df = spark.createDataFrame([(i, "marina", t) for i, t in enumerate(texts)], "i int, db_id string, sql string")
    got = {r.i: r.executes for r in ex.executes_ok(spark, df, databases).collect()}
    assert [got[i] for i in range(6)] == [True, False, False, False, False, True]


def test_first_row_decides_whether_a_query_executes(spark, databases):
    late_error = "SELECT 1 / (5 - id) FROM range(0, 10, 1, 1)"
    scored = ex.match_batch(spark, pairs_df(spark, [(late_error, GOLD)]), databases)
    row = ex.with_executes(spark, scored, databases).first()
    assert (row.ex, row.pred_status, row.executes) == (0, "exec_error", True)


def test_rewards(spark, databases):
    preds = [GOLD, ALL, None, " ", "DROP TABLE boats", "DELETE FROM boats", "not sql", "WITH a AS (SELECT 1) DELETE FROM boats"]
    scored = ex.with_executes(
        spark, ex.match_batch(spark, pairs_df(spark, [(p, GOLD) for p in preds]), databases), databases
    )
    r1 = {r.i: r.reward for r in reward_r1(scored).collect()}
    assert [r1[i] for i in range(8)] == [1.0, 0, 0, 0, 0, 0, 0, 0]
    r2 = {r.i: r for r in reward_r2(scored).collect()}
    assert r2[0].reward == 7.0 and r2[0].breakdown.schema == 1.0
    assert 2.5 <= r2[1].reward <= 4 and r2[1].ex == 0 and r2[1].breakdown.syntax == 1.0
    assert [r2[i].reward for i in range(2, 7)] == [0.0] * 5
    assert r2[7].breakdown.format == 1.0 and r2[7].breakdown.syntax == 0.0 and r2[7].ex == 0
    r3 = {r.i: r.reward for r in reward_r3(scored.withColumn("called_describe", F.col("i") < 2)).collect()}
    assert r3[0] == pytest.approx(1.5) and r3[1] == pytest.approx(0.5) and r3[2] == 0.0


def test_score_completions(spark, databases):
    questions = spark.createDataFrame([(0, "marina", GOLD)], "qid long, db_id string, gold_sql string")
    from queryscore.functions.messages import MESSAGE
    desc = ("assistant", None, [("c1", "describe_table", "{}")], None, None)
    say = lambda t: ("assistant", t, None, None, None)
    comps = [[say(f"let me think\nFINAL SQL: {GOLD}")], [desc, say(f"FINAL SQL: {ALL}")], [say("no sql here")],
             [desc, say(f"FINAL SQL: {GOLD}")], [say("FINAL SQL: DELETE FROM boats")]]
    df = spark.createDataFrame([(i, 0, c) for i, c in enumerate(comps)], f"i int, qid long, completion array<{MESSAGE}>")
    get = lambda arm: [r.reward for r in sorted(score_completions(spark, df, questions, databases, arm).collect(), key=lambda r: r.i)]
    assert get("r1") == [1.0, 0.0, 0.0, 1.0, 0.0]
    r2 = get("r2")
    assert r2[0] == 7.0 and 2.5 <= r2[1] < 7 and r2[2] == 0 and r2[4] == 0
    assert get("r3") == pytest.approx([1.3, 0.5, 0.0, 1.5, 0.0])
    text = spark.createDataFrame([(0, "FINAL SQL: " + GOLD)], "qid long, completion string")
    assert score_completions(spark, text, questions, databases, "r1").first().reward == 1.0
    with pytest.raises(ValueError):
        score_pairs(spark, pairs_df(spark, [(ALL, ALL)]), databases, "r9")


def test_gold_filter_and_self_match(spark, databases):
    rows = [("marina", GOLD), ("marina", " "), ("none", GOLD), ("marina", "SELECT nope"), ("marina", "SELECT 1 WHERE false"), ("marina", None)]
    qs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "qid int, db_id string, gold_sql string")
    got = {r.qid: (r.keep, r.reason) for r in ex.gold_filter(spark, qs, databases).collect()}
    assert [got[i][1] for i in range(6)] == ["ok", "empty_sql", "no_db", "exec_error", "empty_result", "empty_sql"]
    assert [got[i][0] for i in range(6)] == [True] + [False] * 5
    sm = {r.qid: (r.gold_runs, r.missing_db) for r in ex.self_match(spark, qs, databases).collect()}
    assert sm[0] == (1, False) and sm[2] == (0, True) and sm[3] == (0, False) and sm[4] == (1, False)


def test_preview(spark, databases):
    texts = ["SELECT hull, title FROM boats ORDER BY hull", "SELECT hull FROM boats WHERE hull > 99", " InSeRt INTO boats VALUES (9)",
             "SELECT repeat('x', 300)", "SELECT nope"]
    df = spark.createDataFrame([(i, "marina", t) for i, t in enumerate(texts)], "i int, db_id string, sql string")
    got = {r.i: r for r in ex.preview(spark, df, databases, max_rows=2).collect()}
    assert got[0].text == "2 row(s):\n('1', 'Alba')\n('2', 'Brisa')\n(showing first 2)" and got[0].truncated
    assert got[1].text == "(0 rows)" and not got[1].truncated
    assert got[2].text == "Error: read-only: write statements are rejected"
    assert got[3].text == "1 row(s):\n('" + "x" * 200 + "…',)"
    assert got[4].text.startswith("Error: SQL error: ")


def test_one_bad_database_touches_only_its_own_texts(spark, databases, db_root, tmp_path):
    (tmp_path / "bad" / "description").mkdir(parents=True)
    (tmp_path / "bad" / "description" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "bad" / "broken.parquet").write_text("not parquet")
    spark.range(3).write.parquet(str(tmp_path / "bad" / "fine.parquet"))
    more = spark.createDataFrame([("bad", str(tmp_path / "bad")), ("gone", str(tmp_path / "gone")), ("odd", "nofs://x/y")], "db_id string, dir string")
    texts = [("marina", ALL), ("bad", "SELECT id FROM fine"), ("bad", "SELECT * FROM broken"), ("bad", "SELECT * FROM description"), ("gone", ALL), ("odd", "SELECT 1")]
    pairs = spark.createDataFrame([(i, d, t, t) for i, (d, t) in enumerate(texts)], "i int, db_id string, pred_sql string, gold_sql string")
    got = {r.i: (r.ex, r.pred_status) for r in ex.match_batch(spark, pairs, databases.unionByName(more)).collect()}
    failed = (0, "exec_error")
    assert got == {0: (1, "ok"), 1: (1, "ok"), 2: failed, 3: failed, 4: failed, 5: failed}


def test_queries_see_their_own_database_only(spark, databases, db_root, tmp_path):
    spark.range(1).createOrReplaceGlobalTempView("everyone")
    spark.sql("CREATE TABLE IF NOT EXISTS stored AS SELECT 1 AS x")
    try:
        texts = [
            f"SELECT count(*) FROM parquet.`{db_root}/quarry/boats.parquet`", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
            "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
            "SELECT * FROM global_temp.everyone", "SELECT * FROM stored", "SELECT * FROM spark_catalog.default.stored", f"SELECT * FROM text.`{db_root}`",
            "SELECT 1 WHERE EXISTS (SELECT * FROM stored)", "SELECT c.title FROM boats AS c JOIN (SELECT * FROM boats) d ON c.title = d.title",
        ]
        rows = ex.match_batch(spark, pairs_df(spark, [(t, t) for t in texts]), databases).collect()
        assert {r.i: r.pred_status for r in rows} == dict.fromkeys(range(9), "exec_error") | {9: "ok"}
    finally:
        spark.sql("DROP TABLE stored")
        spark.catalog.dropGlobalTempView("everyone")


def test_texts_that_are_no_sql_have_no_schema_items(spark, databases):
    scored = ex.match_batch(spark, pairs_df(spark, [("SELECT title FROM boats WHERE (", GOLD), ("SELECT nope FROM boats", GOLD)]), databases)
    rows = {r.i: r for r in reward_r2(scored.withColumn("executes", F.lit(False))).collect()}
    assert not rows[0].pred_parsed and rows[0].breakdown.schema == 0.0
    assert rows[1].pred_parsed and rows[1].breakdown.schema > 0


def test_errors_are_whole_and_many_outcomes_take_the_same_path(spark, databases, monkeypatch):
    monkeypatch.setattr(ex, "_BATCH_ROWS", 3)
    long = "x" * 500
    texts = [f"SELECT {i}" for i in range(10)] + [f"SELECT {long} FROM boats", None, "  "]
    df = spark.createDataFrame([(i, "marina", t) for i, t in enumerate(texts)], "i int, db_id string, sql string")
    got = {r.i: r.text for r in ex.preview(spark, df, databases).collect()}
    assert [got[i] for i in range(10)] == [f"1 row(s):\n('{i}',)" for i in range(10)]
    assert long in got[10] and got[11] == got[12] == "Error: SQL error: empty query"


def test_a_text_must_parse_by_itself_and_names_may_look_like_plans(spark, databases):
    texts = [
        "SELECT count(*) FROM boats) UNION ALL SELECT * FROM (SELECT 1", "SELECT count(*) FROM boats AS `a.b`", "SELECT 'SubqueryAlias x.y'",
        "SELECT TRANSFORM(title) USING 'cat' AS (t) FROM boats", "BEGIN SELECT 1; END", "EXPLAIN SELECT 1", "SHOW TABLES",
        "FROM boats INSERT INTO boats SELECT * INSERT INTO boats SELECT *", "WITH b AS (SELECT 1 AS x) SELECT * FROM b WHERE x IN (SELECT hull FROM boats)",
        "SELECT 1 -- a comment", "VALUES (1), (2)", "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r",
    ]
    rows = ex.match_batch(spark, pairs_df(spark, [(t, t) for t in texts]), databases).collect()
    good = {1, 2, 8, 9, 10, 11}
    assert {r.i: r.pred_status for r in rows} == {i: "ok" if i in good else "exec_error" for i in range(len(texts))}


def test_many_texts_share_jobs_and_verdicts_stay_the_same(spark, databases):
    texts = [f"SELECT title, {i} FROM boats WHERE hull % {1 + i % 5} = 0" for i in range(60)]
    texts += [f"SELECT {i} / (hull - hull) FROM boats" for i in range(5)] + ["SELECT nope", "SELECT 1 WHERE false"]
    pairs = pairs_df(spark, [(t, texts[(7 * i) % len(texts)] if i % 3 else t) for i, t in enumerate(texts)])
    counted = {}
    for pack in (1, 32):
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        before = _last_job(spark)
        rows = ex.match_batch(spark, pairs, databases, pack=pack, concurrency=2).collect()
        counted[pack] = (_last_job(spark) - before, sorted((r.i, r.ex, r.pred_status, r.gold_status) for r in rows))
    assert counted[1][1] == counted[32][1] and {v[2] for v in counted[1][1]} == {"ok", "exec_error"}
    assert counted[32][0] < 0.75 * counted[1][0]


def _last_job(spark):
    """The number of jobs so far."""
    spark.sparkContext.setJobGroup(group := f"count-{id(object())}", "")
    spark.range(1).collect()
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_stored_outcomes_are_used_until_the_database_changes(spark, db_root, databases, tmp_path):
    import shutil

    from queryscore.operators.outcomes import OutcomeStore

    copy = str(tmp_path / "marina")
    shutil.copytree(f"{db_root}/marina", copy)
    own = spark.createDataFrame([("marina", copy)], "db_id string, dir string")
    store = OutcomeStore(spark, str(tmp_path / "store"))
    ran = []

    def step(preds):
        pairs = pairs_df(spark, [(p, GOLD) for p in preds])
        ran.clear()
        original = ex._run_batch

        def spy(items, *rest):
            ran.extend(i.sql for i in items)
            return original(items, *rest)

        ex._run_batch = spy
        try:
            rows = score_pairs(spark, pairs, own, "r2", store=store).collect()
        finally:
            ex._run_batch = original
        return {r.i: (r.ex, round(r.reward, 6)) for r in rows}

    fresh = "SELECT title FROM boats WHERE harbour IN ('Oslo')"
    first = step([GOLD, ALL, "SELECT nope", "SELECT rand()"])
    assert GOLD in ran and first[0] == (1, 7.0)
    second = step([GOLD, ALL, "SELECT nope", fresh])
    assert set(ran) == {fresh} and {i: second[i] for i in (0, 1, 2)} == {i: first[i] for i in (0, 1, 2)} and second[3][0] == 1
    step(["SELECT rand()"])
    assert ran == ["SELECT rand()"]
    spark.createDataFrame([(99, "Zora", "Oslo")], "hull long, title string, harbour string").write.mode("append").parquet(f"{copy}/boats.parquet")
    step([GOLD])
    assert ran == [GOLD]


def test_a_text_that_hangs_while_it_is_planned_is_left_behind(spark, databases):
    """The JVM's own sleep stands for an expression that takes for ever: it is evaluated while planning."""
    from queryscore.operators.dispatch import TooSlow, Watcher

    watcher = Watcher(spark.sparkContext)
    ended = []

    def stubborn():
        import time
        while not ended:  # deaf to interrupts
            time.sleep(0.05)

    try:
        for fn in (stubborn, lambda: spark._jvm.java.lang.Thread.sleep(60_000)):
            with pytest.raises(TooSlow):
                watcher.limited(fn, 0.5)
        assert watcher.limited(lambda: spark.range(5).count(), 20)[0] == 5
        with pytest.raises(ZeroDivisionError):
            watcher.limited(lambda: 1 / 0, 5)
    finally:
        ended.append(True)
        watcher.close()
    folding = "SELECT aggregate(sequence(1, 3000000), 0L, (a, x) -> a + aggregate(sequence(1, 2000), 0L, (b, y) -> b + y % x))"
    rows = ex.match_batch(spark, pairs_df(spark, [(folding, ALL), (ALL, ALL)]), databases, timeout_s=3, concurrency=1).collect()
    assert {r.i: r.pred_status for r in rows} == {0: "timeout", 1: "ok"}


def test_halves_and_packs():
    from queryscore.operators.dispatch import halves, packs

    runs = []

    def run(items):
        runs.append(len(items))
        if any(i % 10 == 3 for i in items):
            raise ValueError
        return [(i, "ok") for i in items]

    found = halves(list(range(20)), run, lambda i, e: (i, type(e).__name__))
    assert dict(found) == {i: "ValueError" if i % 10 == 3 else "ok" for i in range(20)} and len(runs) < 20
    assert packs([1, 2, 9, 1, 1, 1, 1], lambda i: i, 3, 5) == [[1, 2], [9], [1, 1, 1], [1]]
    assert packs([], len, 3, 5) == []


def test_texts_are_taken_apart_once(spark, databases):
    """The plan over the rows reads dictionary entries; a gold shared by many rows has one."""
    from queryscore.operators.texts import text_parts

    scored = pairs_df(spark, [(f"SELECT title FROM boats WHERE hull = {i % 7}", GOLD) for i in range(200)]).selectExpr("*", "0 AS ex", "true AS executes")
    texts = scored.selectExpr("pred_sql AS sql").union(scored.selectExpr("gold_sql AS sql")).union(scored.selectExpr("CAST(NULL AS STRING) AS sql"))
    assert text_parts(texts).count() == 8
    out = reward_r2(scored)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("breakdown.schema > 0.4 AND breakdown.ngram > 0").count() == 200


def test_texts_that_look_up_keys_are_one_join(spark, databases):
    """Verdicts are those of single runs, with keys that break, are missing or come twice; jobs do not grow with the keys."""
    def pairs(keys):
        look = [f"SELECT title, harbour FROM boats WHERE hull = {k}" for k in keys]
        rows = [(t, t + " ORDER BY title") for t in look] + [(t + " AND hull <= 9", t) for t in look]
        return pairs_df(spark, rows + [(f"SELECT  title FROM  BOATS b WHERE hull ={k}", f"SELECT title FROM boats WHERE {k} = hull") for k in keys])

    def verdicts(df, **options):
        before = _last_job(spark)
        rows = ex.match_batch(spark, df, databases, **options).collect()
        return _last_job(spark) - before, sorted((r.i, r.ex, r.pred_status, r.gold_status) for r in rows)

    keys = [*range(1, 40), "07"]
    _, alone = verdicts(pairs(keys), pack=1)
    jobs, joined = verdicts(pairs(keys))
    assert joined == alone and {v[1] for v in joined} == {0, 1}
    simple = [pairs_df(spark, [(f"SELECT title FROM boats WHERE hull = {k}", f"SELECT title, 1 FROM boats WHERE hull = {k}") for k in range(n)]) for n in (40, 400)]
    few, many = (verdicts(df)[0] for df in simple)
    assert many <= few + 2

    broken = pairs_df(spark, [(f"SELECT 1 / (hull - {n}) FROM boats WHERE hull = {k}", f"SELECT title FROM boats WHERE hull = {k}") for n in (7, 99) for k in range(60)])
    _, alone = verdicts(broken, pack=1)
    _, joined = verdicts(broken)
    assert joined == alone and sum(v[2] == "exec_error" for v in joined) == 1
    never = pairs_df(spark, [(f"SELECT 1 / (hull - hull) FROM boats WHERE hull = {k}", f"SELECT title FROM boats WHERE hull = {k}") for k in range(60)])
    _, joined = verdicts(never)
    assert [v[1:3] for v in joined] == [(0, "exec_error") if 1 <= k <= 21 else (1, "ok") for k in range(60)]


def test_what_counts_as_a_lookup(spark, databases, db_root):
    from queryscore.operators import lookups

    session = ex.DatabaseSessions(spark).get(f"{db_root}/marina")
    cases = [
        ("SELECT * FROM boats WHERE hull = 3", ["hull"]), ("SELECT title FROM boats b WHERE title IS NOT NULL AND b.hull=3 ORDER BY hull", ["hull"]),
        ("SELECT slip + 1 FROM moorings WHERE berth = 3 AND slip = 4", ["berth", "slip"]),
        ("SELECT hull = 3 FROM boats WHERE hull = 3", None), ("SELECT title FROM boats WHERE hull = 3 OR hull = 4", None),
        ("SELECT title FROM boats WHERE NOT hull = 3", None), ("SELECT title FROM boats WHERE hull = 3 AND 1 / hull > 0", None),
        ("SELECT count(*) FROM boats WHERE hull = 3", None), ("SELECT DISTINCT title FROM boats WHERE hull = 3", None),
        ("SELECT title FROM boats WHERE hull = 3 LIMIT 1", None), ("SELECT title, rand() FROM boats WHERE hull = 3", None),
        ("SELECT title FROM boats, moorings WHERE hull = 3", None), ("SELECT title FROM boats WHERE title = 3", None),
        ("SELECT fee FROM moorings WHERE fee = 3", None), ("SELECT title FROM boats WHERE hull = (SELECT min(slip) FROM moorings WHERE berth = 3)", None),
        ("SELECT explode(array(1, 2)) FROM boats WHERE hull = 3", None), ("SELECT hull FROM (SELECT hull + 1 AS hull FROM boats) WHERE hull = 3", None),
    ]
    assert [(f := lookups.lookup_of(session, sql)) and f.columns for sql, _ in cases] == [c[1] for c in cases]
    none = ["SELECT 1", "SELECT title FROM boats WHERE hull >= 3", "SELECT title FROM boats WHERE hull = 3.5", "SELECT title FROM boats WHERE hull = 1234567890",
            "SELECT 'x' FROM boats WHERE hull = 3", "SELECT title FROM boats WHERE hull = 3 -- x", "SELECT title FROM boats WHERE hull == 3L", "SELECT title FROM boats WHERE hull = -3"]
    assert [t for t in none if lookups.shape_of(t)] == []
    texts = spark.createDataFrame([(t,) for t in [c[0] for c in cases] + none], "sql string")
    assert all(r.shape == lookups.shape_of(r.sql) for r in texts.withColumn("shape", lookups.shape_order(F.col("sql"))).collect())


def test_texts_of_a_join_that_break_tell_their_own_errors(spark, databases, monkeypatch):
    """Errors, verdicts and sizes are those of single runs; jobs grow neither with the texts that break nor with those that do not parse."""
    def outcomes(texts, mode="match", **options):
        asked = spark.createDataFrame([("marina", t) for t in texts], "db_id string, sql string")
        before = _last_job(spark)
        rows = ex.run_queries(spark, asked, databases, mode, 60, **options).collect()
        jobs = _last_job(spark) - before
        return jobs, sorted((r.sql, r.status, r.error, r.parsed, r.n_rows, r.n_distinct) for r in rows)

    shapes = [
        # most titles are no numbers, hull 7 divides by zero, hulls 5 and 12 have no title
        "SELECT 100 / (hull - 7), title AS t, CAST(title AS INT) FROM boats WHERE hull = {}",
        # what two columns share, in a sort too
        "SELECT 1 / (hull - hull), 1 / (hull - hull) + 1, hull AS h FROM boats WHERE hull = {} ORDER BY harbour",
        # slips 7 and 28 of berth 8 have the same fee
        "SELECT 1 / (slip - 7), fee FROM moorings WHERE berth = {} AND slip > 2",
        "SELECT hull FROM boats WHERE hull = {}) UNION ALL SELECT * FROM (SELECT 1",
        "SELECT hull FROM boats WHERE hull = {} UNION ALL SELECT",
    ]
    for shape in shapes:
        texts = [shape.format(k) for k in [*range(1, 27), "07"]]
        _, alone = outcomes(texts, pack=1)
        _, joined = outcomes(texts)
        assert joined == alone and sum(o[1] == "exec_error" for o in joined) >= 1
        assert [o[:4] + o[4:5] for o in outcomes(texts, "drain")[1]] == [o[:5] for o in alone]
        padded = [shape.format(f"{k % 21 + 1:0{k // 21 + 1}}") for k in range(160)]
        few, many = (outcomes(padded[:n])[0] for n in (40, 160))
        assert many <= few + 4
    # conditions that a row meets although it has another key
    for shape in ("SELECT title FROM boats WHERE (hull = {}) IS NOT NULL", "SELECT title FROM boats WHERE (hull = {}) = false"):
        _, found = outcomes([shape.format(k) for k in range(100, 130)])
        assert {o[4] for o in found} == {22}

    golds = [(k, f"SELECT 1 / (hull - hull) FROM boats WHERE hull = {k}") for k in range(60)]
    questions = spark.createDataFrame([("marina", k, t) for k, t in golds], "db_id string, k int, gold_sql string")
    reasons = {r.k: r.reason for r in ex.gold_filter(spark, questions, databases).collect()}
    assert reasons == {k: "exec_error" if 1 <= k <= 21 else "empty_result" for k in range(60)}

    # rows that cannot be fetched
    monkeypatch.setattr(ex, "failing_rows", None)
    texts = [shapes[0].format(k) for k in range(1, 27)]
    assert outcomes(texts)[1] == outcomes(texts, pack=1)[1]
