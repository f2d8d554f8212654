"""Prompts, training examples and corpus selection over conversations and documents."""

from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.operators import corpus as c
from queryscore.operators import filters
from queryscore.sources import database as db
from queryscore.sources.records import database_path
from registered import query, table
from registered.execution import HEADERS, KEYS, sample_text

_GOLDS = [
    "SELECT count(*) FROM Orders o JOIN nation n ON o.o_custkey = n.n_nationkey",
    "SELECT 1",
    "",
    "SELECT p_name, (SELECT max(o_orderkey) FROM ORDERS) AS top FROM part, lost_table",
]


def _questions(spark, sf_dir):
    """User turns as questions."""
    conv, turn = F.col("conv_id"), F.col("turn")
    db_id = F.when(conv % 3 == 2, F.lit("lost")).otherwise("tpch")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (conv * 100 + turn).alias("qid"), db_id.alias("db_id"), F.col("text").alias("question"),
        F.element_at(F.array(*map(F.lit, _GOLDS)), (conv % 4 + 1).cast("int")).alias("gold_sql"),
        database_path("/data", db_id).alias("db_path"),
        F.when(turn % 4 == 0, F.concat(F.lit("turn "), turn.cast("string"))).otherwise("").alias("evidence"),
    )


def _lit(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_QUESTIONS = f"""questions AS (SELECT conv_id * 100 + turn AS qid, CASE WHEN conv_id % 3 = 2 THEN 'lost' ELSE 'tpch' END AS db_id, text AS question,
    [{', '.join(map(_lit, _GOLDS))}][conv_id % 4 + 1] AS gold_sql, CASE WHEN turn % 4 = 0 THEN 'turn ' || turn ELSE '' END AS evidence,
    conv_id % 4 AS kind FROM conversations WHERE role = 'user')"""
_EVIDENCE = "CASE WHEN evidence <> '' THEN chr(10) || 'Evidence: ' || evidence ELSE '' END"
_SYSTEM = _lit(fv.SYSTEM_PROMPT)
_ASK = f"'Question: ' || question || chr(10) || 'Database: ' || db_id || {_EVIDENCE}"
_SCHEMA = _lit("\n".join(f"CREATE TABLE {t} ({h})" for t, h in HEADERS.items()))
_SCHEMA_ASK = f"'Schema:' || chr(10) || schema || chr(10) || chr(10) || 'Question: ' || question || {_EVIDENCE}"


def _flat(df, key="qid"):
    return df.select(key, F.posexplode("messages").alias("pos", "m")).select(key, "pos", "m.role", "m.content")


def _flat_sql(source, *messages, key="qid"):
    return " UNION ALL ".join(
        f"SELECT {key}, {i} AS pos, '{role}' AS role, {content} AS content FROM {source}"
        for i, (role, content) in enumerate(messages)
    )


def _known(spark):
    return spark.createDataFrame([("tpch", "/data/tpch")], "db_id string, dir string")


def _tables(spark, sf_dir):
    return db.register_database(spark.newSession(), sf_dir)


def _columns(spark, tables):
    return db.columns_catalog(spark, {"tpch": tables})


def _described(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    columns = _columns(spark, tables)
    return columns, db.describe_tables(columns, db.table_samples(spark, "tpch", tables, order_by=KEYS))


@query(f"WITH {_QUESTIONS} " + _flat_sql("questions", ("system", _SYSTEM), ("user", _ASK)))
def prompt_messages(spark, sf_dir):
    return _flat(_questions(spark, sf_dir).withColumn("messages", c.prompt_messages()))


@query(f"WITH {_QUESTIONS} SELECT qid, 2 AS n_messages, {_ASK} AS ask, gold_sql, '/data/' || db_id AS db_path FROM questions")
def grpo_dataset(spark, sf_dir):
    return c.grpo_dataset(_questions(spark, sf_dir)).select(
        "qid", F.size("prompt").alias("n_messages"), F.col("prompt")[1]["content"].alias("ask"), "gold_sql", "db_path"
    )


_WITH_SCHEMA = f"schemed AS (SELECT *, CASE WHEN db_id = 'tpch' THEN {_SCHEMA} ELSE '' END AS schema FROM questions)"


@query(f"WITH {_QUESTIONS}, {_WITH_SCHEMA}, kept AS (SELECT * FROM schemed WHERE gold_sql <> '' AND db_id = 'tpch') "
       + _flat_sql("kept", ("system", _SYSTEM), ("user", _SCHEMA_ASK), ("assistant", "'FINAL SQL: ' || gold_sql")))
def sft_examples(spark, sf_dir):
    schemas = db.schema_text(_columns(spark, _tables(spark, sf_dir)))
    return _flat(c.sft_examples(_questions(spark, sf_dir), schemas, _known(spark)))


@query(f"WITH {_QUESTIONS}, {_WITH_SCHEMA} " + _flat_sql("schemed", ("system", _SYSTEM), ("user", _SCHEMA_ASK)))
def singleturn_prompts(spark, sf_dir):
    schemas = db.schema_text(_columns(spark, _tables(spark, sf_dir)))
    return _flat(c.singleturn_prompts(_questions(spark, sf_dir), schemas))


def _synth(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"), F.col("lang").alias("db_id"), F.col("source").alias("question"),
        F.lit(None).cast("string").alias("external_knowledge"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n "), "text")).alias("cot"),
        F.concat(F.lit("SELECT "), F.col("doc_id").cast("string"), F.lit(" \n")).alias("sql"),
        F.col("lang").alias("sql_complexity"),
    )


def _lang_schemas(spark, sf_dir):
    """One schema text for each language but German, from the smallest document id."""
    docs = table(spark, sf_dir, "documents").filter("lang <> 'de'")
    return docs.groupBy(F.col("lang").alias("db_id")).agg(
        F.concat(F.lit("CREATE TABLE t"), F.min("doc_id").cast("string")).alias("schema")
    )


_LANGS = "langs AS (SELECT lang, 'CREATE TABLE t' || min(doc_id) AS schema FROM documents WHERE lang <> 'de' GROUP BY lang)"
_SYNTH = f"""{_LANGS}, synth AS (SELECT doc_id AS pos_, source AS question, '' AS evidence, coalesce(l.schema, '') AS schema,
    CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\\s+', '') || chr(10) ELSE '' END || 'FINAL SQL: SELECT ' || doc_id AS answer
    FROM documents d LEFT JOIN langs l ON d.lang = l.lang)"""


@query(f"WITH {_SYNTH} SELECT pos_ AS doc_id, pos, role, content FROM ("
       + _flat_sql("synth", ("system", _SYSTEM), ("user", _SCHEMA_ASK), ("assistant", "answer"), key="pos_") + ")")
def synth_examples(spark, sf_dir):
    made = c.synth_to_sft(_synth(spark, sf_dir), _lang_schemas(spark, sf_dir))
    return _flat(made.withColumnRenamed("pos", "doc_id"), "doc_id")


@query(f"""WITH {_QUESTIONS} SELECT 'gold' AS source, count(*) AS n FROM questions WHERE gold_sql <> '' AND db_id = 'tpch'
UNION ALL SELECT 'agentic', count(*) FROM questions WHERE gold_sql <> '' AND db_id = 'tpch'
UNION ALL SELECT 'synth', count(*) FROM documents""")
def mixed_corpus_counts(spark, sf_dir):
    columns, texts = _described(spark, sf_dir)
    questions = _questions(spark, sf_dir)
    mixed = c.mix_corpora(
        gold=c.sft_examples(questions, db.schema_text(columns), _known(spark)),
        agentic=c.agentic_trajectories(questions, _known(spark), columns, texts),
        synth=c.synth_to_sft(_synth(spark, sf_dir), _lang_schemas(spark, sf_dir)),
    )
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_QUESTIONS} SELECT qid, CASE WHEN db_id = 'tpch' THEN CASE kind WHEN 0 THEN 'orders,nation' WHEN 3 THEN 'orders,part' ELSE 'benchmark,conversations,customer' END END AS tables FROM questions")
def gold_tables(spark, sf_dir):
    columns = _columns(spark, _tables(spark, sf_dir))
    return c.gold_tables(_questions(spark, sf_dir), columns).select("qid", F.array_join("tables", ",").alias("tables"))


_TEXTS = "texts AS (SELECT table_name AS t, text FROM (" + " UNION ALL ".join(
    sample_text(n) for n in ("nation", "orders", "part", "benchmark", "conversations", "customer")
) + "))"


@query(f"""WITH {_QUESTIONS}, {_TEXTS},
kept AS (SELECT *, CASE kind WHEN 0 THEN ['orders', 'nation'] WHEN 3 THEN ['orders', 'part'] ELSE ['benchmark', 'conversations', 'customer'] END AS named
    FROM questions WHERE gold_sql <> '' AND db_id = 'tpch'),
told AS (SELECT qid, unnest(named) AS t, unnest(range(1, len(named) + 1)) AS i FROM kept)
SELECT qid, 0 AS pos, 'system' AS role, {_SYSTEM} AS content, '' AS calls, NULL AS call_id FROM kept
UNION ALL SELECT qid, 1, 'user', {_ASK}, '', NULL FROM kept
UNION ALL SELECT qid, 2, 'assistant', {_lit(fv.LIST_TABLES_TURN)}, 'call_1 {{}}', NULL FROM kept
UNION ALL SELECT qid, 3, 'tool', 'Tables: {', '.join(HEADERS)}', '', 'call_1' FROM kept
UNION ALL SELECT qid, 4, 'assistant', {_lit(fv.DESCRIBE_TURN)},
    array_to_string(list_transform(range(1, len(named) + 1), lambda i: 'call_' || (i + 1) || ' {{"table":"' || named[i] || '"}}'), ','), NULL FROM kept
UNION ALL SELECT qid, CAST(4 + i AS INT), 'tool', text, '', 'call_' || (i + 1) FROM told JOIN texts USING (t)
UNION ALL SELECT qid, CAST(5 + len(named) AS INT), 'assistant', 'FINAL SQL: ' || gold_sql, '', NULL FROM kept""")
def agentic_trajectories(spark, sf_dir):
    columns, texts = _described(spark, sf_dir)
    made = c.agentic_trajectories(_questions(spark, sf_dir), _known(spark), columns, texts)
    rows = made.select("qid", F.posexplode("messages").alias("pos", "m"))
    calls = F.transform(
        F.coalesce("m.tool_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")),
        lambda x: F.concat(x["id"], F.lit(" "), x["arguments"]),
    )
    return rows.select(
        "qid", "pos", "m.role", "m.content", F.array_join(calls, ",").alias("calls"), F.col("m.tool_call_id").alias("call_id")
    )


@query(f"""WITH {_QUESTIONS} SELECT count(*) FILTER (WHERE gold_sql <> '' AND db_id = 'tpch') AS written,
    count(*) FILTER (WHERE gold_sql = '' OR db_id <> 'tpch') AS skipped FROM questions""")
def trajectories_written_and_skipped(spark, sf_dir):
    columns, texts = _described(spark, sf_dir)
    questions = _questions(spark, sf_dir)
    return c.written_and_skipped(questions, c.agentic_trajectories(questions, _known(spark), columns, texts))


@query("""SELECT doc_id, lang, md5(text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 30) WHERE m <= 120""")
def stratified_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return c.stratified_head(docs, "lang", 120, "doc_id").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 6000) WHERE m <= 12000""")
def stratified_head_orders(spark, sf_dir):
    # two strata have nearly half of the rows each
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return c.stratified_head(orders, "o_orderstatus", 12_000, "o_orderkey", strata=2)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 12000")
def head_n_orders(spark, sf_dir):
    return filters.head_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 12_000, "o_orderkey")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def head_n(spark, sf_dir):
    return filters.head_n(table(spark, sf_dir, "documents").select("doc_id", "source"), 25, "doc_id")


@query(f"WITH {_QUESTIONS} SELECT qid, gold_sql FROM questions WHERE gold_sql <> '' AND db_id = 'tpch'")
def usable_questions(spark, sf_dir):
    return filters.usable(_questions(spark, sf_dir), _known(spark)).select("qid", "gold_sql")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS db_id FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def missing_databases(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("db_id"))
    served = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("db_id")
    ).distinct()
    return filters.missing_databases(customers, served)


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS schema
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def attach_schema(spark, sf_dir):
    schemas = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("db_id"), F.col("n_name").alias("schema")
    )
    records = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("db_id"))
    return c.attach_schema(records, schemas).select("c_custkey", "schema")
