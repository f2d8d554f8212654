"""Column functions against the expected values of plain Python rules."""

import random

import pytest
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.functions import messages as msg
from queryscore.functions import similarity as sim
from queryscore.functions import sql_text as st


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


FINAL_CASES = {
    "reasoning...\nFINAL SQL: SELECT 1;": "SELECT 1",
    "no marker here": None,
    "FINAL SQL: SELECT name FROM t\nThis should work.": "SELECT name FROM t",
    "FINAL SQL:\n```sql\nSELECT a\nFROM b\nWHERE c\n```\nbye": "SELECT a\nFROM b\nWHERE c",
    "FINAL SQL: SELECT 1; that's my answer": "SELECT 1",
    "final   sql: ```select 2;```": "select 2",
    "FINAL SQL: ```sql\nSELECT 1": "```sql",
    "FINAL SQL: ``` ```": None,
    "FINAL SQL:": None,
    "FINAL SQL: ;": None,
    "FINAL SQL: a FINAL SQL: b": "a FINAL SQL: b",
    "FINAL SQL: 　SELECT 1 ": "SELECT 1",
    "": None,
}


def test_extract_final_sql(spark):
    got = apply(spark, [*FINAL_CASES, None], st.extract_final_sql)
    assert got == [*FINAL_CASES.values(), None]


def test_prefix_checks(spark):
    texts = ["SELECT 1", "  with a", "selection", "(select 1)", "-- c\nselect", "", " ", None, " Select x"]
    assert apply(spark, texts, st.is_select) == [True, True, True, False, False, False, False, False, True]
    assert apply(spark, [f" \n{w.upper()}x" for w in fv.WRITE_WORDS], st.looks_like_write) == [True] * 15
    assert apply(spark, ["select 1", None, "xdrop"], st.looks_like_write) == [False] * 3


def test_cells_and_rows(spark):
    assert apply(spark, [None, "a" * 200, "é" * 201], st.cap_cell) == ["NULL", "a" * 200, "é" * 200 + "…"]
    values = ["it's", 'a"b', "both ' and \"", "back\\slash", "line\nbreak\ttab", "", "é…"]
    assert apply(spark, values, lambda c: st.row_text([c])) == [str((v,)) for v in values]
    assert apply(spark, values, lambda c: st.row_text([c, F.lit("x")])) == [str((v, "x")) for v in values]


def slow_bigrams(text):
    """Distinct neighbours, by walking over the characters."""
    pairs, left, word = set(), None, ""

    def emit(token):
        nonlocal left
        if left is not None:
            pairs.add((left, token))
        left = token

    for ch in (text or "").lower():
        starts = ch == "_" or "a" <= ch <= "z"
        if starts or (word and (ch.isalnum() or ch == "_")):
            word += ch
            continue
        if word:
            emit(word)
            word = ""
        if not ch.isspace():
            emit(ch)
    if word:
        emit(word)
    return pairs


def test_bigrams_match_a_slow_walk_on_random_text(spark):
    rng = random.Random(5)
    alphabet = "aZ_9é²½,.'\"( \t\n  　́ß中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", "one", None, "SELECT a FROM b WHERE a FROM b"]
    got = apply(spark, texts, sim.bigrams)
    for text, pairs in zip(texts, got):
        assert len(pairs) == len(set(pairs))
        assert {tuple(p.split(" ")) for p in pairs} == slow_bigrams(text), repr(text)


def test_jaccard(spark):
    df = spark.createDataFrame(
        [(["a", "a", "b"], ["b", "c"]), ([], []), (["a"], []), ([], ["a"])], "a array<string>, b array<string>"
    )
    got = [r[0] for r in df.select(sim.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 / 3), 1.0, 0.0, 0.0]
    one = spark.range(1).select(
        sim.bigram_jaccard(F.lit("SELECT 1"), F.lit("SELECT 1")).alias("same"),
        sim.schema_link_jaccard(F.lit("SELECT x FROM a"), F.lit("SELECT y FROM b")).alias("none"),
        sim.schema_link_jaccard(F.lit("SELECT x FROM a"), F.lit("SELECT A.X FROM A")).alias("case"),
    ).first()
    assert (one.same, one.none, one.case) == (1.0, 0.0, 1.0)


SCHEMA_CASES = [
    ("SELECT title FROM boats WHERE harbour='Oslo'", {"t:boats", "c:title", "c:harbour"}),
    ("SELECT c.title, count(*) AS n, sum(o.amount) tot FROM boats c, orders AS o "
     "WHERE c.hull = o.berth AND o.d > date '1995-01-01' GROUP BY c.title ORDER BY n DESC LIMIT 5",
     {"t:boats", "t:orders", "c:title", "c:amount", "c:hull", "c:berth", "c:d", "c:n"}),
    ("WITH x AS (SELECT a b, t.* FROM db.tab t LEFT JOIN u USING (k)) SELECT CASE WHEN z IS NOT DISTINCT FROM q "
     "THEN 1 ELSE 2 END AS w, CAST(p AS decimal(10,2)) FROM x WHERE f IN (SELECT g FROM h) -- FROM zz",
     {"t:tab", "t:u", "t:x", "t:h", "c:a", "c:*", "c:k", "c:z", "c:q", "c:p", "c:f", "c:g"}),
    ("select 'it''s from x' /* from y */ , b from t", {"t:t", "c:b"}),
    ('select "Full Name" from T1 join `my tab` on T1.a = [b c]', {"t:t1", "t:my tab", "c:full name", "c:a", "c:b c"}),
    ("select extract(year from d), upper(trim(s)) from t", {"t:t", "c:d", "c:s"}),
    ("select x from (select y as x from inner_t) sub where x > 1e3", {"t:inner_t", "c:x", "c:y"}),
    ("select first, last, name, row, range, filter from t", {"t:t", "c:first", "c:last", "c:name", "c:row", "c:range", "c:filter"}),
    ("select T1.end, T1 . first, t1.order from t as T1", {"t:t", "c:end", "c:first", "c:order"}),
    ("select sum(a) filter (where b > 1) over (partition by c order by d nulls last rows between 2 preceding and current row) "
     "from t full outer join u on x = y fetch first 5 rows only", {"t:t", "t:u", "c:a", "c:b", "c:c", "c:d", "c:x", "c:y"}),
    ("select 1", set()),
    (None, set()),
]


def test_schema_items(spark):
    got = apply(spark, [c[0] for c in SCHEMA_CASES], sim.schema_items)
    for (text, want), items in zip(SCHEMA_CASES, got):
        assert set(items) == want, text


def test_schema_items_of_very_long_texts(spark):
    n = 50_000
    texts = [
        "select * from " + ", ".join(["t"] * n), "select a" + ".b" * n + " from t", "select * from t" + " a, t" * n,
        "select " + ", ".join(f"c{i} as a{i}" for i in range(n // 10)) + " from t", "(" * n + "a b , . ' \" ` [ " * n,
        "'" * n, '"' * (n + 1), "/*" * n, "from " * n, "a " * (n * 4),
    ]
    got = apply(spark, texts, sim.schema_items)
    assert set(got[0]) == {"t:t"} and set(got[1]) == {"t:t", "c:b"} and len(got) == len(texts)


def test_messages(spark):
    rows = [
        [("assistant", "a", [("1", "list_tables", "{}"), ("2", "", "{}"), ("3", None, "{}")], None, None),
         ("tool", None, None, None, None), ("assistant", "b", [("4", "describe_table", "{}")], None, None)],
        [("assistant", "I would describe_table it", None, None, None)],
        [("assistant", "no", None, None, None)],
        [],
    ]
    kind = f"array<{msg.MESSAGE}>"
    assert apply(spark, rows, msg.completion_text, kind) == ["a\nb", "I would describe_table it", "no", ""]
    assert apply(spark, rows, msg.tool_names, kind) == [["list_tables", "describe_table"], [], [], []]
    assert apply(spark, rows, msg.called_describe, kind) == [True, True, False, False]


def test_columns_work_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("x FINAL SQL: SELECT 1;",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = (
        stream.select(st.extract_final_sql(F.col("text")).alias("sql")).writeStream.format("memory")
        .queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [r.sql for r in spark.table("answers").collect()] == ["SELECT 1"]


def test_open_comments_and_many_names_take_linear_time(spark):
    import time

    texts = ["/* " * 350_000, "/*" * 100_000, "SELECT " + ", ".join(f"c{i}" for i in range(50_000)) + " FROM t",
             "SELECT a FROM " + ", ".join(f"t{i}" for i in range(50_000)), "SELECT a /* b */, c FROM t /* open FROM u"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    started = time.time()
    got = {r.i: r.items for r in df.select("i", sim.schema_items(F.col("t")).alias("items")).collect()}
    assert time.time() - started < 20
    assert got[0] == got[1] == [] and len(got[2]) == len(got[3]) == 50_001 and got[4] == ["t:t", "c:a", "c:c"]
