import random

import pytest

from queryscore.llm import mixture


def _shares(sizes, weights=(5, 2, 1)):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        goal = {s: 2 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in capped and goal[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return goal
        capped |= over


def test_targets_equal_the_repeated_sharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 100, 1000]) * rng.randrange(1, 9) for i in range(12)} | {None: 500}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        found = {r.source: r.target for r in mixture.targets(frame).collect()}
        assert found == pytest.approx(_shares(sizes))


def test_mix_takes_what_it_should(documents, prose):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        rows.append((i, " ".join(prose(rng.randrange(0, 120), i)), source))
    rows += [(1000, None, "a"), (1001, " ", "a"), (None, "x y", "b"), (5, "x y", "b"), (5, "x y", "b")]
    docs = documents(rows)
    found = mixture.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        assert r["size"] == len((r.text or "").split()) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    goals = _shares(sizes)
    for source, size in sizes.items():
        own = [r for r in found if r.source == source]
        assert {r.source_size for r in own} == {size} and own[0].target == pytest.approx(goals[source])
        assert abs(sum(r.taken for r in own) - goals[source]) <= 121
    # the same again, however the rows are dealt
    again = mixture.mix(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    emitted = mixture.emit(docs)
    assert emitted.count() == sum(r.copies for r in found) and emitted.columns == [*docs.columns, "copy"]


def test_empty_tables_sources_without_words_and_clashing_columns(spark, documents):
    assert mixture.mix(documents([])).count() == 0
    rows = mixture.mix(documents([(1, None), (2, "")])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    clash = spark.createDataFrame([(1, "a b", "s", 9, 8)], "doc_id long, text string, source string, size int, _task int")
    row = mixture.mix(clash).first()
    assert row["size"] == 2 and row["_task"] == 8


def test_emit_keeps_clashing_columns_and_repeated_rows(spark, documents, prose):
    rows = [(i, " ".join(prose(20 + i % 7, i)), "s", 7, 8, 9) for i in range(60)] + [(99, "a b c d e", "s", 1, 2, 3)] * 9 + [(None, "n n n", None, 1, 1, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copy int, _key int")
    emitted = mixture.emit(docs)
    assert emitted.columns == ["doc_id", "text", "source", "size", "_key", "copy"]
    found = emitted.collect()
    mixed = mixture.mix(docs, carry=["doc_id"]).collect()
    assert len(found) == sum(r.copies for r in mixed) > 60
    assert {(r["size"], r["_key"]) for r in found if r.doc_id == 5} == {(7, 9)}
    assert sum(r.doc_id == 99 for r in found) == sum(r.copies for r in mixed if r.doc_id == 99)
    assert mixture.emit(documents([])).count() == 0
