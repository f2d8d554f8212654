"""Columns of documents with the names that operators use inside."""

from queryscore.llm import decontaminate, quality_fm, toxicity

COLUMNS = "doc_id long, text string, _text string, _Text_ int"


def test_columns_named_like_internal_ones(spark, prose):
    passage = " ".join(prose(30, 77, 5000))
    rows = [(i, " ".join(prose(40, i)), f"t{i}", i) for i in range(12)] + [(50, f"so {passage} it is", "x", 5), (51, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = decontaminate.find(docs, bench, docs.columns).collect()
    assert [(r.doc_id, r._text, r["_Text_"], r.item_id) for r in found] == [(50, "x", 5, 1)]
    clean = decontaminate.drop(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 13
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for module in (quality_fm, toxicity):
        scored = module.classify(docs, labels, docs.columns).collect()
        assert {(r.doc_id, r._text) for r in scored} == {(r[0], r[2]) for r in rows}
        assert all(0 <= r.score <= 1 for r in scored)
