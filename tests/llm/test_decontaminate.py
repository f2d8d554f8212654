import random

import pyarrow as pa

from queryscore.llm import decontaminate
from queryscore.llm.tokens import NOT_ALNUM, chunks, words_of


def _slow(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_the_table_of_distances():
    rng = random.Random(3)
    for _ in range(300):
        pattern = [rng.randrange(4) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        assert decontaminate.myers(decontaminate._masks(_array(pattern)), len(pattern), text) == _slow(pattern, text)


def _array(x):
    import numpy as np

    return np.array(x, np.uint64)


def test_every_passage_within_the_budget_is_found(spark, documents, prose):
    rng = random.Random(5)
    items = [(i, " ".join(prose(10 + 3 * i, 100 + i, 5000))) for i in range(12)]
    rows, want = [], set()
    for i, text in items:
        words = text.split()
        for edits in (0, decontaminate.budget(len(words))):
            changed = list(words)
            for k in rng.sample(range(len(words)), edits):
                changed[k] = "edited"
            doc = len(rows)
            rows.append((doc, " ".join(prose(100, doc, 5000) + changed + prose(50, doc + 500, 5000))))
            want.add((doc, i))
    half = items[-1][1].split()
    rows += [(900, " ".join(prose(100, 900, 5000))), (901, None), (902, ""), (903, " ".join(half[: len(half) // 2])), (904, items[3][1].upper().replace(" ", ", ")), (904, items[3][1])]
    benchmark = spark.createDataFrame([*items, (50, None), (51, ""), (52, "...")], "item_id long, text string")
    found = decontaminate.find(documents(rows), benchmark, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(904, 3)}
    assert len(found) == len(want) + 2
    for r in found:
        assert r.distance <= decontaminate.budget(r.end_word - r.first_word + r.distance)
    clean = decontaminate.drop(documents(rows), benchmark)
    assert clean.columns == documents(rows).columns
    assert sorted(r.doc_id for r in clean.collect()) == [900, 901, 902, 903]


def test_blocks_and_empty_tables(spark, documents, monkeypatch):
    benchmark = spark.createDataFrame([(i, f"item number {i} with some more words") for i in range(5)], "item_id long, text string")
    docs = documents([(1, "before item number 3 with some more words after")])
    whole = decontaminate.find(docs, benchmark, ["doc_id"]).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    assert sorted(decontaminate.find(docs, benchmark, ["doc_id"]).collect()) == sorted(whole)
    assert decontaminate.drop(docs, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, none, ["doc_id"]).count() == 0 and decontaminate.drop(docs, none).count() == 1
    assert decontaminate.find(documents([]), benchmark, ["doc_id"]).count() == 0
    clash = docs.withColumnRenamed("lang", "distance")
    assert decontaminate.find(clash, benchmark, clash.columns).where("item_id = 3").first().distance == 0


def test_repeated_piece_words_are_one_hit():
    items = decontaminate.Items([(1, "a a a a a a a a")])
    ((_, _, data, bounds),) = chunks(pa.array(["a " * 30]))
    assert decontaminate._matches(items, words_of(data, bounds, NOT_ALNUM)) == {(0, 0): (0, 0, 8)}
