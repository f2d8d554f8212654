import zlib

import numpy as np
import pyarrow as pa
import pytest

from queryscore.llm import quality_fm, toxicity
from queryscore.llm.tokens import NOT_ALNUM, chunks, words_of


def _score(model, text):
    ((_, _, data, bounds),) = chunks(pa.array([text]))
    return float(model.scores(words_of(data, bounds, NOT_ALNUM))[0])


def _toxic_sample(prose):
    texts, labels = [], []
    for i in range(400):
        words = prose(40, i, 300)
        toxic = i % 4 == 0
        if toxic:
            words[i % 40] = ["grumbleton", "grumblefish"][i % 8 // 4]
            if i % 3:
                words[(i + 7) % 40] = "muslims"
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_counterfactuals_take_the_weight_off_identity_terms(prose):
    texts, labels = _toxic_sample(prose)
    neutral = " ".join(prose(30, 999, 300))
    gap = {}
    for strength in (0.0, 20.0):
        model = toxicity.train_on(texts, labels, strength)
        gap[strength] = _score(model, neutral + " muslims") - _score(model, neutral)
        assert _score(model, neutral + " grumbleton") > 0.3 > _score(model, neutral)
        assert _score(model, neutral + " grumblesome") > 0.3  # shares its beginning with labelled words
    assert gap[20.0] < 0.05 < gap[0.0]
    assert toxicity.swapped("the muslims said") == ("the christians said", "the  said")
    assert toxicity.swapped("nobody said") is None


def _auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    positive = labels.sum()
    return (rank[labels == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(labels) - positive))


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_fm, "quality")])
def test_held_out_documents_are_told_apart(spark, documents, prose, module, label):
    rows, labels = [], []
    for i in range(400):
        words = prose(60, i, 2000)
        mark = i % 3 == 0
        if mark and label == "toxic":
            words[i % 60] = "grumbleton"
        if not mark and label == "quality":
            words = [words[0]] * 60 if i % 2 else [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        # labels of the held-out fold are turned round: they must not matter
        held_out = zlib.crc32(str(i).encode()) % module.FOLDS == module.HELD_OUT
        labels.append((i, int(mark) ^ int(held_out)))
    rows += [(1000, None), (1001, ""), (None, "words without an id"), (1002, "one"), (1002, "one")]
    frame = spark.createDataFrame(labels, f"doc_id long, {label} int")
    found = module.classify(documents(rows), frame, ["doc_id"]).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.score >= module.THRESHOLD) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % module.FOLDS == module.HELD_OUT}
    truth = np.array([r.doc_id % 3 == 0 for r in held], float)
    assert _auc(truth, np.array([r.score for r in held])) > 0.95


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_fm, "quality")])
def test_no_labels_and_no_documents(spark, documents, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = module.classify(documents([(1, "a b c")]), none, ["doc_id"]).collect()
    assert len(rows) == 1 and 0 <= rows[0].score <= 1
    assert module.classify(documents([]), none, ["doc_id"]).count() == 0


def test_factorisation_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = quality_fm.Model(
        0.3, rng.normal(size=quality_fm.BUCKETS + len(quality_fm.STATISTICS)),
        rng.normal(size=(quality_fm.BUCKETS + len(quality_fm.STATISTICS), quality_fm.FACTORS)),
        np.zeros(len(quality_fm.STATISTICS)), np.ones(len(quality_fm.STATISTICS)),
    )
    ((_, _, data, bounds),) = chunks(pa.array(["some words of some text | # A", "b", ""]))
    rows = quality_fm.rows_of(words_of(data, bounds), bounds)
    for i, got in enumerate(model.parts(rows)[0]):
        own = slice(rows.offsets[i], rows.offsets[i + 1])
        at = np.concatenate([rows.at[own], quality_fm.BUCKETS + np.arange(len(quality_fm.STATISTICS))])
        x = np.concatenate([rows.x[own], model.dense(rows.stats)[i]])
        want = model.bias + model.w[at] @ x
        for j in range(len(at)):
            for k in range(j):
                want += model.v[at[j]] @ model.v[at[k]] * x[j] * x[k]
        assert got == pytest.approx(want)


def test_rejected_documents_go_and_columns_stay(spark, documents, prose):
    rows = [(i, " ".join(prose(60, i, 2000)) if i % 3 else "x " * 60, "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    docs = documents(rows)
    good = quality_fm.keep_good(docs.withColumnRenamed("lang", "score"), labels)
    assert good.columns == [c if c != "lang" else "score" for c in docs.columns] and good.first().score == "en"
    assert {r.doc_id for r in good.collect()} == {i for i in range(300) if i % 3}
