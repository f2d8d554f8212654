"""Summaries and training-log statistics over labels, documents and events."""

from pyspark.sql import functions as F

from queryscore.operators import filters, metrics as m
from registered import query, table

_RESULTS_SQL = """
results AS (SELECT source, quality AS ex, CAST(quality AS DOUBLE) + toxic / 2.0 AS reward,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic = 0 END AS finished,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not sql' ELSE 'SELECT ' || doc_id END AS final_sql,
    n_chars AS turns, CASE WHEN doc_id % 3 = 0 THEN 1 END AS ex_fallback
    FROM labels JOIN documents USING (doc_id))"""


def _results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    key = F.col("doc_id")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "source", F.col("quality").alias("ex"),
        (F.col("quality").cast("double") + F.col("toxic") / 2).alias("reward"),
        F.when(key % 7 != 0, F.col("toxic") == 0).alias("finished"),
        F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, F.lit("not sql"))
        .otherwise(F.concat(F.lit("SELECT "), key.cast("string"))).alias("final_sql"),
        F.col("n_chars").alias("turns"),
        F.when(key % 3 == 0, F.lit(1)).alias("ex_fallback"),
    )


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


_RATES = ["ex_rate", "ex_rate_fallback", "mean_reward", "finished_rate", "valid_sql_rate", "avg_turns"]


def _summary_sql(valid):
    return f"""count(*) AS n, round(avg(ex), 6) AS ex_rate, round(avg(coalesce(ex_fallback, ex)), 6) AS ex_rate_fallback,
    round(avg(reward), 6) AS mean_reward, round(avg(coalesce(finished, false)::INT), 6) AS finished_rate,
    round(avg(({valid})::INT), 6) AS valid_sql_rate, round(avg(turns), 6) AS avg_turns"""


_IS_SELECT = "coalesce(starts_with(lower(final_sql), 'select'), false)"


@query(f"WITH {_RESULTS_SQL} SELECT source, {_summary_sql(_IS_SELECT)} FROM results GROUP BY source")
def summary_by_source(spark, sf_dir):
    return _rounded(m.summarize(_results(spark, sf_dir), "source"), *_RATES)


@query(f"WITH {_RESULTS_SQL} SELECT source, {_summary_sql('final_sql IS NOT NULL')} FROM results GROUP BY source")
def compare_summary_by_source(spark, sf_dir):
    return _rounded(m.compare_summary(_results(spark, sf_dir), "source"), *_RATES)


@query(f"""WITH {_RESULTS_SQL},
b AS (SELECT count(*) AS n, avg(ex) AS e, avg(coalesce(ex_fallback, ex)) AS f FROM results WHERE source = 'src0'),
t AS (SELECT count(*) AS n, avg(ex) AS e, avg(coalesce(ex_fallback, ex)) AS f FROM results WHERE source <> 'src0')
SELECT b.n AS baseline_n, t.n AS tuned_n, round(t.e - b.e, 6) AS ex_delta, round(t.f - b.f, 6) AS ex_delta_fallback,
    t.e > b.e AS passed FROM b, t""")
def compare_sources(spark, sf_dir):
    results = _results(spark, sf_dir)
    out = m.compare(results.filter("source = 'src0'"), results.filter("source <> 'src0'"))
    return _rounded(
        out.select("baseline_n", "tuned_n", "ex_delta", "ex_delta_fallback", "passed"),
        "ex_delta", "ex_delta_fallback",
    )


@query(f"""WITH {_RESULTS_SQL} SELECT source, count(*) AS n, CAST(sum(ex) AS BIGINT) AS n_ex, round(avg(ex), 6) AS ex_rate,
    round(avg(coalesce(finished, false)::INT), 6) AS finished_rate FROM results GROUP BY source""")
def singleturn_summary(spark, sf_dir):
    return _rounded(m.summarize_singleturn(_results(spark, sf_dir), "source"), "ex_rate", "finished_rate")


@query("SELECT difficulty, count(*) AS n FROM (SELECT o_orderpriority AS difficulty FROM orders) WHERE difficulty IN ('1-URGENT', '2-HIGH') GROUP BY difficulty")
def difficulty_histogram(spark, sf_dir):
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("difficulty"))
    return m.histogram(filters.filter_difficulty(questions, ["1-URGENT", "2-HIGH"]), "difficulty")


@query("SELECT count(*) FILTER (quality = 1) AS kept, count(*) AS total, round(count(*) FILTER (quality = 1) / count(*), 6) AS ratio FROM labels")
def keep_ratio(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("keep"))
    return _rounded(m.keep_ratio(labels), "ratio")


@query(f"""WITH {_RESULTS_SQL}, r AS (SELECT source AS tag, count(*) AS n, sum(ex) AS h FROM results GROUP BY source),
b AS (SELECT n AS bn, h AS bh FROM r WHERE tag = 'src0'),
v AS (SELECT tag, n, h / n AS rate, h / n - bh / bn AS delta, (h + bh) / (n + bn) AS p, bn FROM r, b WHERE tag <> 'src0')
SELECT tag, n, round(rate, 6) AS rate, round(delta, 6) AS delta,
    round(CASE WHEN p > 0 AND p < 1 THEN delta / sqrt(p * (1 - p) * (1.0::DOUBLE / n + 1.0::DOUBLE / bn)) END, 6) AS z FROM v""")
def proportion_ztest(spark, sf_dir):
    return _rounded(m.proportion_ztest(_results(spark, sf_dir), "src0", tag="source").drop("p_value"), "rate", "delta", "z")


# Every source of the documents.
_ARMS = [f"src{i}" for i in range(20)]


@query(f"""WITH {_RESULTS_SQL}, r AS (SELECT source, avg(ex) AS ex, avg(coalesce(finished, false)::INT) AS finished,
    avg({_IS_SELECT}::INT) AS valid_sql FROM results GROUP BY source),
l AS (SELECT source, 'ex' AS metric, ex AS v FROM r UNION ALL SELECT source, 'finished', finished FROM r
    UNION ALL SELECT source, 'valid_sql', valid_sql FROM r)
SELECT metric, {", ".join(f"round(max(v) FILTER (source = '{arm}') * 100, 4) AS {arm}" for arm in _ARMS)} FROM l GROUP BY metric""")
def metric_pivot(spark, sf_dir):
    return m.metric_pivot(_results(spark, sf_dir), _ARMS, "source")


@query("""WITH g AS (SELECT user_id, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY user_id)
SELECT event_id, user_id, round(CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0 END, 6) AS advantage
FROM events JOIN g USING (user_id)""")
def group_advantage(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return _rounded(m.group_advantage(events, "user_id", "value").drop("value"), "advantage")


@query("""SELECT step, count(*) AS n_groups, round(avg(varied), 6) AS density FROM (
    SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS step, user_id,
        (min((event_type = 'error')::INT) <> max((event_type = 'error')::INT))::INT AS varied
    FROM events GROUP BY 1, 2) GROUP BY step""")
def gradient_density(spark, sf_dir):
    rollouts = table(spark, sf_dir, "events").select(
        F.unix_date(F.to_date("ts")).cast("long").alias("step"), "user_id",
        (F.col("event_type") == "error").cast("int").alias("reward"),
    )
    return _rounded(m.gradient_density(rollouts, group="user_id"), "density")


def _log(spark, sf_dir):
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    hours = F.timestamp_diff("HOUR", epoch, F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), hours.alias("step")).agg(
        F.avg("value").alias("reward")
    )


_LOG_SQL = "log AS (SELECT event_type AS arm, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, avg(value) AS reward FROM events GROUP BY 1, 2)"


@query(f"""WITH {_LOG_SQL} SELECT arm, step, rn AS position, round(r, 6) AS rolling FROM (
    SELECT arm, step, row_number() OVER (PARTITION BY arm ORDER BY step) AS rn,
        avg(reward) OVER (PARTITION BY arm ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS r FROM log)
WHERE rn >= 12""")
def rolling_mean_12(spark, sf_dir):
    return _rounded(m.rolling_mean(_log(spark, sf_dir)), "rolling")


@query(f"""WITH {_LOG_SQL} SELECT arm, count(*) AS n, round(avg(reward), 6) AS tail_mean FROM (
    SELECT *, row_number() OVER (PARTITION BY arm ORDER BY step DESC) AS rn FROM log) WHERE rn <= 50 GROUP BY arm""")
def tail_mean_50(spark, sf_dir):
    return _rounded(m.tail_mean(_log(spark, sf_dir)), "tail_mean")


@query(f"""WITH {_LOG_SQL} SELECT arm, step,
    round(reward / CASE arm WHEN 'click' THEN 1.0 WHEN 'view' THEN 7.0 END, 6) AS normalised FROM log""")
def normalised_reward(spark, sf_dir):
    out = m.normalise_reward(_log(spark, sf_dir), {"click": 1.0, "view": 7.0})
    return _rounded(out.drop("reward"), "normalised")


@query(r"""SELECT lang, count(*) AS n, round(quantile_cont(k, 0.99), 6) AS p99, max(k) AS max_length,
    round(avg((k > 600)::INT), 6) AS over_limit
FROM (SELECT lang, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS k FROM documents)
GROUP BY lang""")
def length_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    out = m.length_profile(docs, m.token_count(F.col("text")), 600, "lang")
    return _rounded(out.withColumn("max_length", F.col("max_length").cast("long")), "p99", "over_limit")
