"""Text columns and similarity scores over documents, conversations and orders."""

from pyspark.sql import functions as F

from queryscore.functions import messages as msg
from queryscore.functions import similarity as sim
from queryscore.functions import sql_text as st
from queryscore.operators.texts import with_schema_link
from queryscore.scratch import materialise
from registered import query, table


@query("""
SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN NULL
    WHEN 1 THEN 'SELECT ' || doc_id || ' FROM t'
    WHEN 2 THEN 'SELECT ' || doc_id
    WHEN 3 THEN 'SELECT a' || chr(10) || 'FROM t' || doc_id
    WHEN 4 THEN '```sql'
    ELSE NULL END AS final_sql
FROM documents
""")
def final_sql_extract(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    answer = (
        F.when(F.col("doc_id") % 6 == 0, F.lit(""))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("\nFINAL SQL: SELECT "), key, F.lit(" FROM t\nThis works.")))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("\nfinal  sql:\n SELECT "), key, F.lit(" ; done; FINAL SQL: x")))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("\nFINAL SQL: ```sql\nSELECT a\nFROM t"), key, F.lit(";\n```\nbye")))
        .when(F.col("doc_id") % 6 == 4, F.lit("\nFINAL SQL: ```sql\nSELECT 1"))
        .otherwise(F.lit("\nFINAL SQL: ;"))
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", st.extract_final_sql(F.concat("text", answer)).alias("final_sql"))


@query("""
SELECT kind, CAST(sum(is_select) AS BIGINT) AS n_select, CAST(sum(is_write) AS BIGINT) AS n_write, count(*) AS n FROM (
    SELECT doc_id % 5 AS kind, (doc_id % 5 IN (0, 1))::INT AS is_select, (doc_id % 5 IN (2, 3))::INT AS is_write
    FROM documents)
GROUP BY kind
""")
def sql_prefix_flags(spark, sf_dir):
    starts = F.element_at(
        F.array(*map(F.lit, ["  SELECT ", "\nwith x as ", "\t Update ", "DROPS ", "-- select "])),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 5).alias("kind"), F.concat(starts, "text").alias("sql")
    )
    return docs.groupBy("kind").agg(
        F.sum(st.is_select(F.col("sql")).cast("long")).alias("n_select"),
        F.sum(st.looks_like_write(F.col("sql")).cast("long")).alias("n_write"),
        F.count(F.lit(1)).alias("n"),
    )


@query("""
SELECT doc_id,
    CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS shown,
    CASE WHEN quality IS NULL THEN 'NULL' ELSE CAST(quality AS VARCHAR) END AS quality
FROM documents LEFT JOIN labels USING (doc_id)
""")
def cell_display(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", st.cap_cell(F.col("text")).alias("shown"), st.cap_cell(F.col("quality")).alias("quality")
    )


@query("""
SELECT conv_id, turn,
    text || CASE WHEN turn % 3 = 2 THEN chr(10) || 'then describe_table' ELSE '' END AS completion,
    CASE turn % 3 WHEN 0 THEN 'describe_table,run_sql' WHEN 1 THEN 'list_tables' ELSE '' END AS tools,
    turn % 3 <> 1 AS called_describe
FROM conversations
""")
def completion_messages(spark, sf_dir):
    call = lambda name: F.struct(F.lit("c").alias("id"), F.lit(name).alias("name"), F.lit("{}").alias("arguments"))
    kind = F.col("turn") % 3
    calls = F.when(kind == 0, F.array(call("describe_table"), call(""), call("run_sql"))).when(
        kind == 1, F.array(call("list_tables"))
    )
    note = F.when(kind == 2, F.lit("then describe_table"))
    completion = F.array(
        msg.message("assistant", F.col("text"), calls), msg.message("tool", F.lit(None).cast("string")),
        msg.message("assistant", note),
    )
    rows = table(spark, sf_dir, "conversations").withColumn("m", completion)
    return rows.select(
        "conv_id", "turn", msg.completion_text(F.col("m")).alias("completion"),
        F.array_join(msg.tool_names(F.col("m")), ",").alias("tools"),
        msg.called_describe(F.col("m")).alias("called_describe"),
    )


_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PAIRS = rf"""
words AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[A-Za-z_][\p{{L}}\p{{N}}_]*|[^{_SPACES}]') AS w
    FROM conversations),
pairs AS (SELECT conv_id, turn,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM words)"""


@query(rf"""
WITH {_PAIRS}
SELECT a.conv_id, a.turn, len(a.p) AS n_pairs, round(CASE WHEN len(a.p) = 0 AND len(b.p) = 0 THEN 1.0
    WHEN len(a.p) = 0 OR len(b.p) = 0 THEN 0.0
    ELSE len(list_intersect(a.p, b.p)) / (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p))) END, 9) AS overlap
FROM pairs a JOIN pairs b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def bigram_jaccard_turns(spark, sf_dir):
    # The pair sets are built once per turn, before the self join.
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", sim.bigrams(F.col("text")).alias("p"))
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("next_p"))
    return rows.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size("p").cast("long").alias("n_pairs"),
        F.round(sim.jaccard(F.col("p"), F.col("next_p")), 9).alias("overlap"),
    )


@query("""
SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS schema_link
FROM orders
""")
def schema_link_orders(spark, sf_dir):
    customer = F.col("o_custkey").cast("string")
    gold = F.concat(F.lit("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = "), customer)
    kind = F.col("o_orderkey") % 5
    pred = (
        F.when(kind == 0, F.concat(F.lit("select orders.o_totalprice total, o_orderkey as k\nfrom Orders where o_custkey="), customer))
        .when(kind == 1, F.concat(F.lit("SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = "), customer))
        .when(kind == 2, F.concat(
            F.lit("SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '"),
            "o_orderpriority", F.lit("'")))
        .when(kind == 3, F.lit("SELECT count(*) FROM part"))
        .otherwise(F.lit("SELECT 1"))
    )
    pairs = materialise(table(spark, sf_dir, "orders").select("o_orderkey", pred.alias("pred"), gold.alias("gold")), "pairs")
    return with_schema_link(pairs, "pred", "gold").select("o_orderkey", "schema_link")
