import os
import subprocess
import sys

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import REPO


def test_pipeline_over_a_small_corpus(spark, documents, prose, tmp_path):
    item = prose(40, 5000, 5000)
    rows, labels = [], []
    for i in range(150):
        words, good = prose(80, i, 5000), i % 5 > 0
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), ["a", "b", None][i % 3]))
        labels.append((i, int(good)))
    rows += [
        (200, rows[1][1], "a"), (201, rows[1][1].replace("w", "w", 1) + " end", "b"),  # copies of 1
        (202, " ".join(prose(50, 202, 5000) + item + prose(50, 203, 5000)), "a"),  # holds the test item
        (203, " ".join(prose(80, 204, 5000)) + " mail someone@example.org", "a"), (204, None, "a"), (205, "", "b"),
    ]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "mixed":
            assert docs.columns == columns
    good = {i for i in range(150) if i % 5}
    assert good | {200, 201, 202, 203} <= ids["quality"] and not ids["quality"] & {i for i in range(150) if i % 5 == 0}
    assert ids["near_duplicates"] & {1, 200, 201} == {1} and good <= ids["near_duplicates"]
    assert ids["decontaminated"] == ids["near_duplicates"] - {202}
    masked = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "masked")).collect()}
    assert masked.keys() == ids["decontaminated"] and masked[203].endswith("mail [EMAIL]")
    assert ids["mixed"] <= ids["masked"] and ids["mixed"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.copy) for r in run.collect()) == sorted((r.doc_id, r.copy) for r in docs.collect())


def test_pipeline_over_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_the_rest_does_not_import_this_package():
    code = "import sys, registered; registered.load_all(); assert not [m for m in sys.modules if m.startswith('queryscore.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
