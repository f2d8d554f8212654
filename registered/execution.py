"""Batches of SQL texts over the driver's tables."""

from functools import reduce

from pyspark.sql import functions as F

from queryscore.operators import execution as ex
from queryscore.operators import metrics, rewards
from queryscore.scratch import materialise
from queryscore.sources import database as db
from registered import query, table

_URGENT = "SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'"
_FLAGS = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus"
_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity < 25"
_BRANDS = "SELECT p_brand, count(*) FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand"
_NATIONS = "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"
_COUNT = "SELECT count(*) FROM orders"

# exec_id, tag, predicted text, gold text, and what the pair must come to where SQL set
# operators cannot say it (errors, type rules): (ex, predicted status, gold status).
PAIRS = [
    ("p01", "first", "WITH t AS (SELECT * FROM lineitem) SELECT l_returnflag, l_linestatus, count(l_orderkey), sum(l_quantity) FROM t GROUP BY l_returnflag, l_linestatus ORDER BY 3 DESC", _FLAGS, None),
    ("p02", "first", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag, l_linestatus", _FLAGS, None),
    ("p03", "first", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", _URGENT, None),
    ("p04", "first", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'", _URGENT, None),
    ("p05", "first", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE NOT l_quantity >= 25", _LINES, None),
    ("p06", "first", "SELECT l_linenumber, l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity < 25", _LINES, None),
    ("p07", "second", "SELECT brand FROM part", _BRANDS, (0, "exec_error", "ok")),
    ("p08", "second", "  ", _BRANDS, (0, "empty_sql", "ok")),
    ("p09", "second", "DELETE FROM lineitem", _BRANDS, (0, "exec_error", "ok")),
    ("p10", "second", "SELECT p_brand, count(*) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) > 0;", _BRANDS, (1, "ok", "ok")),
    ("p11", "second", "SELECT CAST(count(*) AS DOUBLE) FROM orders", _COUNT, None),
    ("p12", "second", "SELECT CAST(count(*) AS VARCHAR(20)) FROM orders", _COUNT, (0, "ok", "ok")),
    ("p13", "second", "SELECT n_name, n_name FROM nation WHERE n_nationkey < 0", "SELECT n_name FROM nation WHERE n_nationkey < 0", (1, "ok", "ok")),
    ("p14", "second", _NATIONS, "SELECT n_nom FROM nation", (0, "ok", "exec_error")),
    ("p15", "second", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA'", _NATIONS, None),
    ("p16", "second", "SELECT 1 / (o_orderkey - o_orderkey) FROM orders", _COUNT, (0, "exec_error", "ok")),
    ("p17", "second", "SELECT count(* FROM orders o_orderkey", _COUNT, (0, "exec_error", "ok")),
    ("p19", "second", "SELECT count(*) FROM nation) UNION ALL SELECT * FROM (SELECT 1", _COUNT, (0, "exec_error", "ok")),
    ("p20", "second", "SELECT count(*) FROM orders WHERE o_orderpriority <> 'SubqueryAlias x.y'", _COUNT, None),
    ("p18", "second", "SELECT count(*) + 0 * length(reflect('java.lang.System', 'getProperty', 'user.home')) FROM orders", _COUNT, (0, "exec_error", "ok")),
]


def tpch(spark, sf_dir):
    return spark.createDataFrame([("tpch", sf_dir)], "db_id string, dir string")


def _pairs(spark):
    return spark.createDataFrame(
        [(p[0], p[1], "tpch", p[2], p[3]) for p in PAIRS],
        "exec_id string, tag string, db_id string, pred_sql string, gold_sql string",
    )


def same_rows(a: str, b: str) -> str:
    """SQL condition: both queries have the same set of rows."""
    a, b = (f"SELECT * FROM ({x.strip().removesuffix(';')}) t" for x in (a, b))
    return f"(NOT EXISTS ({a} EXCEPT {b}) AND NOT EXISTS ({b} EXCEPT {a}))"


def _verdict(pair):
    exec_id, tag, pred, gold, fixed = pair
    ex_, pred_status, gold_status = fixed or (f"{same_rows(pred, gold)}::INT", "ok", "ok")
    return (
        f"SELECT '{exec_id}' AS exec_id, '{tag}' AS tag, CAST({ex_} AS INT) AS ex, "
        f"'{pred_status}' AS pred_status, '{gold_status}' AS gold_status"
    )


_VERDICTS = " UNION ALL ".join(_verdict(p) for p in PAIRS)


@query(f"SELECT exec_id, ex, pred_status, gold_status FROM ({_VERDICTS})")
def exec_match_batch(spark, sf_dir):
    out = ex.match_batch(spark, _pairs(spark), tpch(spark, sf_dir))
    return out.select("exec_id", "ex", "pred_status", "gold_status")


def _supplier_pairs(spark, sf_dir):
    """Two texts of its own for every supplier; one prediction in five does not parse, one breaks while it runs."""
    key = F.col("s_suppkey").cast("string")
    lines = F.concat(F.lit("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = "), key)
    kind = F.col("s_suppkey") % 5
    broken = F.concat(F.lit("SELECT 1 / (l_orderkey - l_orderkey), 1 FROM lineitem WHERE l_suppkey = "), key)
    pred = (
        F.when(kind == 0, F.concat(lines, F.lit(") UNION ALL SELECT * FROM (SELECT 1, 2"))).when(kind == 1, broken)
        .when(kind == 2, F.concat(lines, F.lit(" AND l_quantity < 25")))
        .otherwise(F.concat(lines, F.lit(" ORDER BY l_linenumber")))
    )
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("tpch").alias("db_id"), pred.alias("pred_sql"), lines.alias("gold_sql"),
    )


@query("""
SELECT s_suppkey, CAST(CASE s_suppkey % 5 WHEN 0 THEN false WHEN 1 THEN n = 0 WHEN 2 THEN n = small ELSE true END AS INT) AS ex,
       CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 5 = 1 AND n > 0 THEN 'exec_error' ELSE 'ok' END AS pred_status
FROM (SELECT s_suppkey, count(l_orderkey) AS n, count(CASE WHEN l_quantity < 25 THEN 1 END) AS small
      FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)
""")
def exec_match_per_supplier(spark, sf_dir):
    out = ex.match_batch(spark, _supplier_pairs(spark, sf_dir), tpch(spark, sf_dir))
    return out.select("s_suppkey", "ex", "pred_status")


# Every pair whose two texts run.
_RUNNING = [p for p in PAIRS if p[4] is None or p[4][1:] == ("ok", "ok")]


@query(f"SELECT exec_id, ex FROM ({_VERDICTS}) WHERE pred_status = 'ok' AND gold_status = 'ok'")
def result_set_match(spark, sf_dir):
    session = spark.newSession()
    db.register_database(session, sf_dir)
    parts = [
        ex.result_set_match(ex.read_only_query(session, pred), ex.read_only_query(session, gold)).select(F.lit(i).alias("exec_id"), "ex")
        for i, _, pred, gold, _ in _RUNNING
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT exec_id, pred_status = 'ok' AS executes FROM (" + _VERDICTS + ")")
def executes_ok(spark, sf_dir):
    texts = _pairs(spark).select("exec_id", "db_id", F.col("pred_sql").alias("sql"))
    return ex.executes_ok(spark, texts, tpch(spark, sf_dir)).select("exec_id", "executes")


def _scored(spark, sf_dir):
    databases, sessions = tpch(spark, sf_dir), ex.DatabaseSessions(spark)
    matched = ex.match_batch(spark, _pairs(spark), databases, sessions=sessions)
    return ex.with_executes(spark, matched, databases, sessions=sessions)


_SELECTS = "exec_id NOT IN ('p08', 'p09')"


@query(f"SELECT exec_id, ex, CAST(ex AS DOUBLE) AS reward, {_SELECTS} AS valid_sql FROM ({_VERDICTS})")
def reward_r1(spark, sf_dir):
    scored = ex.match_batch(spark, _pairs(spark), tpch(spark, sf_dir))
    return rewards.reward_r1(scored).select("exec_id", "ex", "reward", "valid_sql")


def _r2_sql() -> str:
    """R2 by SQL: token pairs from the texts, schema items written out by hand."""
    flags = "t:lineitem c:l_returnflag c:l_linestatus c:l_quantity"
    lines = "t:lineitem c:l_orderkey c:l_linenumber c:l_quantity c:l_returnflag"
    urgent = "t:customer t:orders c:c_custkey c:o_custkey c:o_orderpriority"
    brands = "t:part t:lineitem c:p_brand c:p_partkey c:l_partkey"
    nations = "t:nation t:region c:n_name c:n_regionkey c:r_regionkey c:r_name"
    items = {
        "p01": (flags + " t:t c:l_orderkey", flags), "p02": (flags + " c:l_discount", flags),
        "p03": (urgent, urgent), "p04": ("t:orders c:o_custkey c:o_orderpriority", urgent),
        "p05": (lines, lines), "p06": (lines, lines), "p07": ("t:part c:brand", brands),
        "p08": ("", brands), "p09": ("t:lineitem", brands), "p10": (brands, brands),
        "p11": ("t:orders", "t:orders"), "p12": ("t:orders", "t:orders"),
        "p13": ("t:nation c:n_name c:n_nationkey", "t:nation c:n_name c:n_nationkey"),
        "p14": (nations, "t:nation c:n_nom"), "p15": (nations, nations),
        "p16": ("t:orders c:o_orderkey", "t:orders"), "p17": ("", "t:orders"), "p18": ("t:orders", "t:orders"),
        "p19": ("", "t:orders"), "p20": ("t:orders c:o_orderpriority", "t:orders"),
    }
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda s: "[" + ", ".join(f"'{x}'" for x in s.split()) + "]::VARCHAR[]"
    texts = " UNION ALL ".join(
        f"SELECT '{p[0]}' AS exec_id, {quoted(p[2])} AS pred, {quoted(p[3])} AS gold, "
        f"{listed(items[p[0]][0])} AS pi, {listed(items[p[0]][1])} AS gi" for p in PAIRS
    )
    words = lambda c: rf"regexp_extract_all(lower({c}), '[a-z_][a-z0-9_]*|[^\s]')"
    grams = lambda c: f"list_distinct(list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"
    overlap = lambda a, b: (
        f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
        f"ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    )
    return f"""
WITH v AS ({_VERDICTS}), x AS ({texts}),
w AS (SELECT *, {words('pred')} AS pw, {words('gold')} AS gw FROM x),
g AS (SELECT *, {grams('pw')} AS pg, {grams('gw')} AS gg FROM w),
s AS (SELECT exec_id, tag, ex, CASE WHEN {_SELECTS} THEN 1::DOUBLE ELSE 0::DOUBLE END AS ok, CASE WHEN pred_status = 'ok' THEN 1::DOUBLE ELSE 0::DOUBLE END AS syntax,
    {overlap('pi', 'gi')} AS schema, {overlap('pg', 'gg')} AS ngram FROM v JOIN g USING (exec_id))
SELECT exec_id, tag, ex, round(ok * (3 * ex + syntax + schema + ngram + 1), 6) AS reward,
    ok * syntax AS syntax, round(ok * schema, 3) AS schema, round(ok * ngram, 3) AS ngram FROM s"""


@query(_r2_sql().replace("exec_id, tag, ex, round", "exec_id, ex, round"))
def reward_r2(spark, sf_dir):
    return rewards.reward_r2(_scored(spark, sf_dir)).select(
        "exec_id", "ex", F.round("reward", 6).alias("reward"), "breakdown.syntax", "breakdown.schema", "breakdown.ngram"
    )


@query(f"""SELECT tag, count(*) AS n, round(avg(ex), 6) AS ex_rate, round(avg(reward), 6) AS mean_reward,
    round(avg(({_SELECTS})::INT), 6) AS valid_sql_rate FROM ({_r2_sql()}) GROUP BY tag""")
def r2_summary_by_tag(spark, sf_dir):
    results = rewards.reward_r2(_scored(spark, sf_dir)).select(
        "tag", "ex", "reward", F.col("pred_sql").alias("final_sql"), F.lit(True).alias("finished"), F.lit(1).alias("turns")
    )
    out = metrics.summarize(results, "tag")
    return out.select("tag", "n", *[F.round(c, 6).alias(c) for c in ("ex_rate", "mean_reward", "valid_sql_rate")])


@query(f"""SELECT exec_id, round(0.2::DOUBLE * (exec_id < 'p09')::INT + 0.3::DOUBLE * (pred_status = 'ok')::INT + ex, 6) AS reward FROM ({_VERDICTS})""")
def reward_r3(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("called_describe", F.col("exec_id") < "p09")
    return rewards.reward_r3(scored).select("exec_id", F.round("reward", 6).alias("reward"))


def _nation_questions(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    kind = F.col("n_nationkey") % 5
    customers = F.concat(F.lit("SELECT c_name FROM customer WHERE c_nationkey = "), key)
    gold = (
        F.when(kind == 0, F.lit(" "))
        .when(kind == 1, F.concat(F.lit("SELECT c_nom FROM customer WHERE c_nationkey = "), key))
        .when(kind == 2, F.concat(customers, F.lit(" AND c_acctbal > 1e12")))
        .otherwise(customers)
    )
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("qid"), F.when(kind == 3, F.lit("lost")).otherwise("tpch").alias("db_id"),
        gold.alias("gold_sql"),
    )


_REASON = """CASE n_nationkey % 5 WHEN 0 THEN 'empty_sql' WHEN 1 THEN 'exec_error' WHEN 2 THEN 'empty_result' WHEN 3 THEN 'no_db'
    ELSE CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) THEN 'ok' ELSE 'empty_result' END END"""


@query(f"SELECT n_nationkey AS qid, {_REASON} AS reason, {_REASON} = 'ok' AS keep FROM nation")
def gold_filter(spark, sf_dir):
    verdicts = ex.gold_filter(spark, _nation_questions(spark, sf_dir), tpch(spark, sf_dir))
    return verdicts.select("qid", "reason", "keep")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM nation) GROUP BY reason")
def gold_filter_reasons(spark, sf_dir):
    verdicts = ex.gold_filter(spark, _nation_questions(spark, sf_dir), tpch(spark, sf_dir))
    return metrics.histogram(materialise(verdicts, "gold"), "reason")


@query("SELECT n_nationkey AS qid, (n_nationkey % 5 IN (2, 4))::INT AS gold_runs, n_nationkey % 5 = 3 AS missing_db FROM nation")
def self_match(spark, sf_dir):
    out = ex.self_match(spark, _nation_questions(spark, sf_dir), tpch(spark, sf_dir))
    return out.select("qid", "gold_runs", "missing_db")


_SHOWN = {
    "a": "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_partkey",
    "b": "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey",
    "c": "SELECT o_orderkey FROM orders WHERE o_totalprice < 0",
    "d": " Drop table orders",
    "e": "SELECT count(*), max(l_shipdate) FROM lineitem",
}


@query("""
SELECT 'a' AS id, '50 row(s):' || chr(10) || string_agg('(''' || p_partkey || ''', ''' || p_name || ''', ''' || p_retailprice || ''')', chr(10) ORDER BY p_partkey)
    || chr(10) || '(showing first 50)' AS text, true AS truncated FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 50)
UNION ALL SELECT 'b', '5 row(s):' || chr(10) || string_agg('(''' || r_regionkey || ''', ''' || r_name || ''')', chr(10) ORDER BY r_regionkey), false FROM region
UNION ALL SELECT 'c', '(0 rows)', false UNION ALL SELECT 'd', 'Error: read-only: write statements are rejected', false
UNION ALL SELECT 'e', '1 row(s):' || chr(10) || '(''' || count(*) || ''', ''' || max(l_shipdate) || ''')', false FROM lineitem
""")
def table_preview(spark, sf_dir):
    asked = spark.createDataFrame([(k, "tpch", v) for k, v in _SHOWN.items()], "id string, db_id string, sql string")
    return ex.preview(spark, asked, tpch(spark, sf_dir)).select("id", "text", "truncated")


# The driver's tables as the catalog shows them, and columns that order each definitely.
HEADERS = {
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "region": "r_regionkey INT, r_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}
_WHOLE = {"conversations": ["conv_id", "turn", "role", "text"], "lineitem": [c.split()[0] for c in HEADERS["lineitem"].split(", ")]}
KEYS = {name: _WHOLE.get(name, [header.split()[0]]) for name, header in HEADERS.items()}


def sample_text(name):
    """SQL: (table_name, text) of a table's description."""
    cells = [f"CAST({c.split()[0]} AS VARCHAR)" for c in HEADERS[name].split(", ")]
    cut = [f"CASE WHEN {c} IS NULL THEN 'NULL' WHEN length({c}) > 200 THEN left({c}, 200) || '…' ELSE {c} END" for c in cells]
    escaped = [f"replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')" for c in cut]
    # quoted like a Python text: in double quotes if it holds single ones only
    quoted = [
        f"CASE WHEN contains({c}, chr(39)) AND NOT contains({c}, chr(34)) THEN chr(34) || {c} || chr(34) "
        f"ELSE chr(39) || replace({c}, chr(39), chr(92) || chr(39)) || chr(39) END" for c in escaped
    ]
    shown = " || ', ' || ".join(quoted)
    key = ", ".join(KEYS[name])
    return (
        f"SELECT '{name}' AS table_name, 'Table {name}:' || chr(10) || 'columns: {HEADERS[name]}' || chr(10) || 'sample:' || chr(10) || "
        f"string_agg('(' || {shown} || ')', chr(10) ORDER BY {key}) AS text FROM (SELECT * FROM {name} ORDER BY {key} LIMIT 3)"
    )


# Embeddings are left out here only: small floats have another text form in SQL.
@query(" UNION ALL ".join(sample_text(name) for name in HEADERS if name != "embeddings"))
def describe_tables(spark, sf_dir):
    tables = db.register_database(spark.newSession(), sf_dir)
    samples = db.table_samples(spark, "tpch", tables, order_by=KEYS)
    return db.describe_tables(db.columns_catalog(spark, {"tpch": tables}), samples).select("table_name", "text").where("table_name <> 'embeddings'")
