"""File sources and the JSONL sink: tables written as record files and read back."""

from pyspark.sql import functions as F

from queryscore.operators.metrics import compare_summary
from queryscore.scratch import scratch_dir
from queryscore.sources import records as rec
from registered import query, table


def _written(spark, df, purpose):
    path = scratch_dir(spark, purpose)
    rec.write_jsonl(df, path)
    return path


@query("""SELECT row_number() OVER (ORDER BY conv_id, turn, text) - 1 AS qid, 'db' || conv_id AS db_id, text AS question,
    CASE turn % 4 WHEN 0 THEN 'SELECT ' || turn WHEN 1 THEN 'SELECT q' WHEN 2 THEN 'SELECT g' ELSE '' END AS gold_sql,
    '/data/db' || conv_id AS db_path, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS evidence, role AS difficulty
FROM conversations""")
def question_records(spark, sf_dir):
    kind = F.col("turn") % 4
    # The sink keeps the sorted order across part files.
    raw = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn", "text").select(
        F.concat(F.lit("db"), F.col("conv_id").cast("string")).alias("db_id"), F.col("text").alias("question"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("evidence"),
        F.when(kind == 0, F.concat(F.lit("SELECT "), F.col("turn").cast("string"))).when(kind == 1, F.lit("")).alias("SQL"),
        F.when(kind == 1, F.lit("SELECT q")).alias("query"), F.when(kind != 3, F.lit("SELECT g")).alias("gold_sql"),
        F.col("role").alias("difficulty"),
    )
    return rec.read_questions(spark, _written(spark, raw, "questions"), "/data")


@query("""SELECT lang AS db_id, 'k' || (doc_id % 3) AS sql_complexity, source AS question, CAST(NULL AS VARCHAR) AS external_knowledge,
    md5(text) AS cot, 'SELECT ' || doc_id AS sql FROM documents""")
def synth_records(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("db_id"), F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("sql_complexity"),
        F.col("source").alias("question"), F.lit(None).cast("string").alias("external_knowledge"),
        F.col("text").alias("cot"), F.concat(F.lit("SELECT "), F.col("doc_id").cast("string")).alias("sql"),
    )
    return rec.read_synth(spark, _written(spark, raw, "synth")).drop("pos").withColumn("cot", F.md5("cot"))


@query("""SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS qid, p_brand AS db_id, p_name AS question, 'SELECT ' || p_partkey AS gold_sql,
    '/data/' || p_brand AS db_path, p_type AS evidence, '' AS difficulty FROM part""")
def question_array_records(spark, sf_dir):
    # One compact array per file: the records of a hundred parts each, file names in order of the keys.
    record = F.to_json(F.struct(
        F.col("p_brand").alias("db_id"), F.col("p_name").alias("question"),
        F.concat(F.lit("SELECT "), F.col("p_partkey").cast("string")).alias("SQL"), F.col("p_type").alias("evidence"),
    ))
    group = F.format_string("%012d", F.floor(F.col("p_partkey") / 100))
    arrays = table(spark, sf_dir, "part").groupBy(group.alias("g")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", record.alias("r")))), lambda x: x["r"]), ",\n").alias("r")
    )
    path = scratch_dir(spark, "arrays")
    arrays.select("g", F.concat(F.lit("["), "r", F.lit("]")).alias("value")).write.partitionBy("g").text(path)
    return rec.read_questions(spark, path, "/data", layout="array")


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS qid, 'db' || c_nationkey AS db_id, c_name AS question, 'SELECT ' || c_custkey AS gold_sql,
    '/data/db' || c_nationkey AS db_path, '{ "a" }' AS evidence, '' AS difficulty FROM customer""")
def question_indented_records(spark, sf_dir):
    # Indented arrays as a pretty-printer writes them, a file for each thousand customers, names in order of the keys.
    fields = {
        "db_id": F.concat(F.lit("db"), F.col("c_nationkey").cast("string")), "question": F.col("c_name"),
        "gold_sql": F.concat(F.lit("SELECT "), F.col("c_custkey").cast("string")), "evidence": F.lit('{ \\"a\\" }'),
    }
    lines = [F.concat(F.lit(f'    "{k}": "'), v, F.lit('"')) for k, v in fields.items()]
    record = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))
    group = F.format_string("%012d", F.floor(F.col("c_custkey") / 1000))
    arrays = table(spark, sf_dir, "customer").groupBy(group.alias("g")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", record.alias("r")))), lambda x: x["r"]), ",\n").alias("r")
    )
    path = scratch_dir(spark, "indented")
    arrays.select("g", F.concat(F.lit("[\n"), "r", F.lit("\n]")).alias("value")).write.partitionBy("g").text(path)
    return rec.read_questions(spark, path, "/data", layout="indented")


@query("""SELECT db_id, CASE WHEN arg_max(p_partkey, p_partkey) % 5 = 0 THEN '' ELSE
    'CREATE ' || arg_max(p_name, p_partkey) || chr(10) || 'CREATE ' || max(p_partkey) END AS schema
FROM (SELECT p_brand AS db_id, * FROM part) GROUP BY db_id""")
def ddl_records(spark, sf_dir):
    # The sink keeps the sorted order across part files, so the last record is the largest key.
    key = F.col("p_partkey")
    ddls = F.array(F.concat(F.lit("CREATE "), "p_name"), F.concat(F.lit("CREATE "), key.cast("string")))
    raw = table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.col("p_brand").alias("db_id"), F.when(key % 5 != 0, ddls).alias("ddls")
    )
    return rec.read_ddl(spark, _written(spark, raw, "ddl"), layout="jsonl")


@query("""SELECT count(*) AS n, round(avg(quality), 6) AS ex_rate,
    round(avg(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END), 6) AS ex_rate_fallback,
    round(avg((doc_id % 4 <> 0)::INT), 6) AS valid_sql_rate, round(avg(coalesce(toxic = 0, false)::INT), 6) AS finished_rate
FROM labels""")
def result_records(spark, sf_dir):
    key = F.col("doc_id")
    raw = table(spark, sf_dir, "labels").select(
        F.lit("d").alias("db_id"), F.when(key % 4 != 0, F.lit("not sql")).alias("final_sql"),
        F.col("quality").alias("ex"), F.col("quality").cast("double").alias("reward"),
        F.struct(F.when(key % 3 == 0, F.lit(1)).alias("ex_fallback")).alias("breakdown"),
        F.lit(1).alias("turns"), F.when(F.col("toxic") == 0, F.lit(True)).alias("finished"),
    )
    out = compare_summary(rec.read_results(spark, _written(spark, raw, "results")))
    rates = ["ex_rate", "ex_rate_fallback", "valid_sql_rate", "finished_rate"]
    return out.select("n", *[F.round(x, 6).alias(x) for x in rates])
