import hashlib
import random
import re

from pyspark.sql import functions as F

from queryscore.llm import exact_dedup


def _plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _weak(text):
    """Eight different hashes: nearly every group is a collision."""
    return F.encode(F.pmod(F.xxhash64(text), F.lit(8)).cast("string"), "UTF-8")


def _expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(_plain(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[_plain(text)]
        known = [i for i in own if i is not None]
        out.append((doc_id, min(known) if known else None, len(own), hashlib.sha256(_plain(text).encode()).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(12)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(3)}" for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(1000 + i, "the hot\ttext") for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, " "), (None, "only here"), (None, "the hot text"), (3000, "x" * 500_000), (3001, "x" * 500_000)]
    return rows + [(7, "again"), (7, "again"), (8, "again"), (None, "nobody"), (None, "nobody")]


def test_classes_with_a_good_and_a_colliding_hash(documents):
    rows = _rows()
    for digest in (exact_dedup.hash128, _weak):
        found = exact_dedup.classes(documents(rows).repartition(5), ["doc_id", "text"], digest).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == _expected(rows)
        kept = [r for r in found if r.kept]
        assert sorted({_plain(r.text) for r in found}) == sorted(_plain(r.text) for r in kept)
        assert all(r.doc_id == r.keep_id for r in kept)


def test_keep_first(documents):
    rows = _rows()
    keeps = {}
    for doc_id, text in rows:
        keeps.setdefault(_plain(text), []).append(doc_id)
    expected = [(min((i for i in own if i is not None), default=None), text) for text, own in keeps.items()]
    for digest in (exact_dedup.hash128, _weak):
        docs = documents(rows)
        found = exact_dedup.keep_first(docs, digest)
        assert found.columns == docs.columns
        assert sorted([(r.doc_id, _plain(r.text)) for r in found.collect()], key=str) == sorted(expected, key=str)


def test_empty_table_and_clashing_columns(spark, documents):
    assert exact_dedup.classes(documents([])).count() == 0 and exact_dedup.keep_first(documents([])).count() == 0
    clash = spark.createDataFrame(
        [(1, "a", 5, 6, "m"), (2, "a", 7, 8, "n")], "doc_id long, text string, _digest int, _place int, keep_id string")
    found = exact_dedup.classes(clash).orderBy("doc_id").collect()
    assert [(r._digest, r._place, r.keep_id, r.kept) for r in found] == [(5, 6, 1, True), (7, 8, 1, False)]
    assert exact_dedup.keep_first(clash).collect() == [clash.first()]


def test_filter_keeps_all_known_digests(spark):
    rows = spark.range(5000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("_digest"), "id")
    found = exact_dedup.marked(rows, rows.where("id % 10 = 0").select("_digest")).where("_maybe")
    assert 500 <= found.count() <= 502 and found.where("id % 10 = 0").count() == 500


def test_what_is_moved(documents):
    """The only broadcasts are the bit map and the hot keys; unique texts are not shuffled."""
    docs = documents([(i, f"text {i % 50}") for i in range(100)])
    plan = exact_dedup.keep_first(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
