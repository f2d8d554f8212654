import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from queryscore.operators import metrics as m
from queryscore.operators import skew

RESULTS = "tag string, final_sql string, ex int, reward double, finished boolean, turns int, ex_fallback int"


def results_df(spark):
    return spark.createDataFrame(
        [("a", "SELECT 1", 1, 1.0, True, 2, None), ("a", "junk", 0, 0.0, True, 4, None),
         ("a", None, 0, 0.0, None, 8, 1), ("b", "with x", 1, 1.0, True, 1, None)], RESULTS)


def test_summaries(spark):
    df = results_df(spark)
    a = m.summarize(df.filter("tag='a'")).first()
    assert (a.n, a.ex_rate, a.ex_rate_fallback) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert (a.valid_sql_rate, a.finished_rate, a.avg_turns) == pytest.approx((1 / 3, 2 / 3, 14 / 3))
    c = m.compare_summary(df.filter("tag='a'")).first()
    assert c.valid_sql_rate == pytest.approx(2 / 3)
    empty = m.summarize(df.filter("tag='z'")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0, 0)
    both = m.compare(df.filter("tag='a'"), df.filter("tag='b'")).first()
    assert both.ex_delta == pytest.approx(2 / 3) and both.ex_delta_fallback == pytest.approx(1 / 3) and both.passed
    st = m.summarize_singleturn(df, "tag").orderBy("tag").first()
    assert (st.n, st.n_ex) == (3, 1)
    pivot = {r.metric: (r.a, r.b) for r in m.metric_pivot(df, ["a", "b"], "tag").collect()}
    assert pivot["ex"] == (33.3333, 100.0)


def test_histogram_and_ratio(spark):
    df = spark.createDataFrame([("ok", True), ("ok", True), ("bad", False)], "reason string, keep boolean")
    assert {r.reason: r.n for r in m.histogram(df, "reason").collect()} == {"ok": 2, "bad": 1}
    assert tuple(m.keep_ratio(df).first()) == (2, 3, pytest.approx(2 / 3))
    assert tuple(m.keep_ratio(df.limit(0)).first()) == (0, 0, 0.0)


def test_ztest_reproduces_reported_significance(spark):
    counts = {"base": 690, "r1": 762, "r2": 800}
    rows = [(tag, int(i < hits)) for tag, hits in counts.items() for i in range(1534)]
    got = {r.tag: r for r in m.proportion_ztest(spark.createDataFrame(rows, "tag string, ex int"), "base").collect()}
    assert set(got) == {"r1", "r2"}
    for tag, r in got.items():
        p1, p0 = counts[tag] / 1534, 690 / 1534
        pool = (counts[tag] + 690) / 3068
        z = (p1 - p0) / math.sqrt(pool * (1 - pool) * 2 / 1534)
        assert r.z == pytest.approx(z)
        assert r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)
    assert 0.005 < got["r1"].p_value < 0.012 and got["r2"].p_value < 1e-4


def test_group_advantage_with_one_dominating_group(spark):
    rng = random.Random(1)
    rows = [(0, rng.choice([0.0, 1.0, 2.5])) for _ in range(4000)] + [(g, rng.random()) for g in range(1, 60) for _ in range(4)]
    rows += [(900, 0.1)] * 5 + [(901, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, qid int, reward double").repartition(6)
    got = {r.i: r.advantage for r in m.group_advantage(df).collect()}
    assert len(got) == len(rows)
    groups = {}
    for i, (g, v) in enumerate(rows):
        groups.setdefault(g, []).append((i, v))
    for g, members in groups.items():
        values = [v for _, v in members]
        if len(set(values)) < 2:
            assert all(got[i] == 0.0 for i, _ in members)
            continue
        mean, std = statistics.fmean(values), statistics.stdev(values)
        assert sum(got[i] for i, _ in members) == pytest.approx(0, abs=1e-6)
        for i, v in members:
            assert got[i] == pytest.approx((v - mean) / std)


def test_gradient_density(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0), (2, 1, 0.5)], "step int, qid int, reward double")
    got = {r.step: (r.n_groups, r.density) for r in m.gradient_density(df).collect()}
    assert got == {1: (2, 0.5), 2: (1, 0.0)}


def test_rolling_tail_and_normalised(spark):
    rng = random.Random(2)
    # gaps between steps, more rows than one block, and an arm shorter than the window
    steps = sorted(rng.sample(range(40000), 9000))
    series = {"r1": [(s, rng.random()) for s in steps], "r2": [(s, 7 * rng.random()) for s in range(1, 8)]}
    rows = [(a, s, v) for a, pts in series.items() for s, v in pts]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "arm string, step long, reward double").repartition(5)
    got = {(r.arm, r.step): (r.position, r.rolling) for r in m.rolling_mean(log).collect()}
    assert len(got) == 9000 - 11
    values = [v for _, v in series["r1"]]
    for i in range(11, 9000):
        position, mean = got["r1", steps[i]]
        assert position == i + 1 and mean == pytest.approx(statistics.fmean(values[i - 11: i + 1]))
    tails = {r.arm: (r.n, r.tail_mean) for r in m.tail_mean(log).collect()}
    assert tails["r1"] == (50, pytest.approx(statistics.fmean(values[-50:]))) and tails["r2"][0] == 7
    row = m.normalise_reward(log, {"r1": 1.0, "r2": 7.0}).filter("arm = 'r2'").first()
    assert row.normalised == pytest.approx(row.reward / 7)


def test_length_profile(spark):
    texts = ["a b c"] * 98 + ["x " * 50, "y " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    r = m.length_profile(df, m.token_count(F.col("text")), limit=100).first()
    assert (r.n, r.max_length, r.over_limit) == (100, 500, 0.01)
    assert r.p99 == pytest.approx(50 + 0.01 * 450)


def test_skewed_left_join_keeps_rows_and_misses(spark):
    # key 1 dominates, null and an unmatched key (99) are frequent as well
    key = (
        F.when(F.col("id") < 3000, 1).when(F.col("id") < 4000, F.lit(None)).when(F.col("id") < 5000, 99)
        .otherwise(F.col("id") % 50)
    )
    rows = spark.range(0, 6000).select("id", key.alias("k")).repartition(7)
    dim = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit(1).alias("w"))
    for heavy in (1, 3, 1000):
        got = skew.left_join_skewed(rows, dim, ["k"], heavy=heavy, least=heavy).collect()
        assert len(got) == 6000
        assert all(r.v == (r.k * 10 if r.k is not None and r.k < 40 else None) for r in got)
    weighted = skew.left_join_skewed(rows, dim, ["k"], "w", heavy=5)
    assert weighted.filter("v IS NOT NULL").count() == rows.filter("k < 40").count()


def test_skewed_join_broadcasts_no_payload(spark):
    """Even keys have no heavy one; wide payload is shuffled, what is broadcast is a hash and a count."""
    rows = spark.range(0, 20_000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 1000).cast("int").alias("k"))
    dim = spark.range(0, 1000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 10_000).alias("wide"))
    plan = skew.left_join_skewed(rows, dim, ["k"])
    broadcast = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "strategy=broadcast" in line]
    assert len(broadcast) == 2 and "wide" not in "".join(broadcast)
    assert plan.agg(F.sum(F.length("wide")), F.count("id")).first()[:] == (20_000 * 10_000, 20_000)
    even = rows.withColumn("k", (F.col("id") % 5000).cast("int"))
    assert skew.left_join_skewed(even, dim, ["k"]).where("wide IS NOT NULL").count() == 4000


def test_no_task_of_a_skewed_join_gets_the_dominating_key(spark):
    """Without broadcast or adaptive splitting, shuffled rows still spread out."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 64000, 1, 64).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("id") % 997).alias("k"))
        dim = spark.range(0, 1000, 1, 2).select(F.col("id").alias("k"), F.col("id").alias("v"))
        out = skew.left_join_skewed(rows, dim, ["k"], heavy=10)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 64000 and len(sizes) == 4 and max(sizes) < 24000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_cuts_by_counts(spark):
    from queryscore.operators.corpus import stratified_head
    from queryscore.operators.filters import head_n

    n = 60_000
    rows = spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("place"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, F.lit(None)).otherwise((F.col("id") % 3).cast("string")).alias("s"))
    plain = sorted((r.place, r.s or "_") for r in rows.collect())
    for total, strata in ((40_000, 4), (1000, 2), (100, 200), (10**6, 3)):
        per, seen, want = max(1, total // strata), {}, []
        for place, s in plain:
            seen[s] = seen.get(s, 0) + 1
            if seen[s] <= per:
                want.append(place)
        got = stratified_head(rows, "s", total, "place", strata)
        assert got.columns == rows.columns and sorted(r.place for r in got.collect()) == want[:total]
    for k in (15_000, n + 5):
        head = head_n(rows, k, "place")
        assert [r.place for r in head.collect()] == [p for p, _ in plain[:k]]
        assert "CollectLimit" not in head._jdf.queryExecution().executedPlan().toString()
    ties = head_n(rows.withColumn("place", F.col("place") % 3), 12_000, "place").collect()
    assert len(ties) == 12_000 and {r.place for r in ties} == {0}
    assert stratified_head(rows.limit(0), "s", 10, "place").count() == 0


def test_no_task_ranks_more_than_a_range(spark):
    places = skew.dealt_by_order(spark.range(0, 200_000, 1, 8).select(F.lit("hot").alias("s"), F.col("id").alias("place")), "place")
    sizes = [r["count"] for r in places.groupBy("_task").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 80_000
    assert skew.nth_by_counts(places, ["s"], "place", 123_456).collect()[0]["_last"] == 123_455
    assert skew.nth_by_counts(places, ["s"], "place", 200_001).count() == 0
