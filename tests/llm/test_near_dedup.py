import numpy as np
import pyarrow as pa
import pytest

from queryscore.llm import near_dedup
from queryscore.llm.graph import components
from queryscore.llm.tokens import chunks, words_of


def _sets(texts):
    out = []
    for first, behind, data, bounds in chunks(pa.array(texts)):
        doc, shingle, weight = near_dedup.shingles(words_of(data, bounds))
        names = near_dedup.signatures(doc, shingle, weight, behind - first)
        cuts = np.searchsorted(doc, np.arange(behind - first + 1))
        out += [(shingle[a:b], weight[a:b], names[i]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def _slow(a, b):
    x, y = (dict(zip(s[0].tolist(), s[1].tolist())) for s in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(k, 0) / x[i], y.get(k, 0) / y[i]) for k in every) for i in set(x) & set(y))


def _similar(a, b):
    """Whether two weighted sets reach 0.8, one pair at a time."""
    if not len(a[0]) or not len(b[0]):
        return len(a[0]) == len(b[0])
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return False
    return len(i) >= 0.8 * (len(a[0]) + len(b[0]) - len(i)) or near_dedup.probability_jaccard(a, b, i, j) >= 0.8


def test_registers_estimate_the_probability_jaccard(prose):
    errors = []
    for seed in range(40):
        words = prose(80, seed, 60)
        other = [w if i % (5 + seed) else w + "x" for i, w in enumerate(words)] + words[:20]
        a, b = _sets([" ".join(words), " ".join(other)])
        exact = _slow(a, b)
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        assert near_dedup.probability_jaccard(a, b, i, j) == pytest.approx(exact)
        errors.append((a[2] == b[2]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def _classes(df):
    found = {}
    for r in near_dedup.classes(df).collect():
        found.setdefault(r.class_id, []).append(r.doc_id)
    return {k: sorted(v) for k, v in found.items()}


def test_classes_of_copies_edits_short_and_missing_texts(documents, prose):
    base = prose(200, 1)
    edit = lambda *at: " ".join(w + "x" if i in at else w for i, w in enumerate(base))
    rows = [
        (5, edit()), (6, edit(10)), (7, edit(100, 150)), (8, " ".join(base).replace(" ", "\n ")), (9, " ".join(prose(200, 2))),
        (1, None), (2, " "), (3, "a b"), (4, "a  b"), (10, "b a"), (11, edit(*range(0, 200, 10))), (12, "x y z"), (12, "x y z"),
    ]
    assert _classes(documents(rows)) == {5: [5, 6, 7, 8], 9: [9], 1: [1, 2], 3: [3, 4], 10: [10], 11: [11], 12: [12, 12]}
    kept = near_dedup.keep_first(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 9, 10, 11, 12]


def test_a_chain_is_one_class_and_a_long_text_is_whole(documents, prose):
    base = prose(300, 3)
    rows, words = [], list(base)
    for step in range(6):  # each differs a little from the one before, the ends a lot
        words = [w + "x" if 40 * step <= i < 40 * step + 24 else w for i, w in enumerate(words)]
        rows.append((step, " ".join(words)))
    long = prose(60_000, 4, 10_000)
    rows += [(100, " ".join(long)), (101, " ".join(long[:-1] + ["end"]))]
    assert _classes(documents(rows)) == {0: [0, 1, 2, 3, 4, 5], 100: [100, 101]}


def test_empty_table_and_null_ids(documents):
    assert near_dedup.classes(documents([])).count() == 0
    assert near_dedup.keep_first(documents([])).count() == 0
    rows = near_dedup.classes(documents([(None, "a b c d e f"), (None, "a b c d e f"), (1, "g")])).collect()
    assert sorted((r.class_id is None, r.copies) for r in rows) == [(False, 1), (True, 2), (True, 2)]


def _components(texts):
    """The smallest number of each text's class, from all pairs that share a band."""
    sets = _sets(texts)
    bands = [set(k) for k in near_dedup.bands(np.array([s[2] for s in sets])).tolist()]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bands[i] & bands[j] and _similar(sets[i][:2], sets[j][:2]):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return [top(i) for i in range(len(texts))]


def _edited(words, at, name):
    return [f"{w}{name}" if i in at else w for i, w in enumerate(words)]


@pytest.mark.parametrize("shape", ["star", "chain"])
def test_classes_of_large_groups_equal_brute_force(documents, prose, shape):
    rng = np.random.default_rng(7)
    base = prose(200, 5, 10_000)
    if shape == "chain":
        texts, words = [], list(base)
        for step in range(300):
            words = _edited(words, {int(rng.integers(200)), int(rng.integers(200))}, "x")
            texts.append(words)
    else:  # copies reach 0.8 to their original and not to each other
        texts = [_edited(base, set(rng.permutation(200)[:4].tolist()), f"e{k}") for k in range(300)] + [base]
    texts = [" ".join(texts[k]) for k in rng.permutation(len(texts))]
    expected = _components(texts)
    found = {r.doc_id: r.class_id for r in near_dedup.classes(documents(list(enumerate(texts)))).collect()}
    assert [found[k] for k in range(len(texts))] == expected
    assert len(set(expected)) == 1


def test_components_of_paths_have_one_root(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(20 + i * 7 % 11, 20 + (i + 1) * 7 % 11) for i in range(10)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 13)} | {i: 20 for i in range(20, 31)}


def test_texts_that_differ_in_repetition_only_share_a_band(prose):
    line = prose(10, 99, 10_000)
    for seed in range(20):
        words = prose(400, seed, 10_000)
        texts = [" ".join(words + line * 40), " ".join(words + line), "a b c", ""]
        a, b = _sets(texts)[:2]
        assert _similar(a[:2], b[:2])
        batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "digest": [1, 2, 3, 4], "text": texts})
        keys = [set(x) for out in near_dedup._signed(iter([batch])) for x in out.column("bands").to_pylist()]
        assert keys[0] & keys[1] and len(keys[0]) > near_dedup.BANDS and len(keys[1]) == len(keys[2]) == near_dedup.BANDS


def test_no_pair_with_a_common_shingle_is_missed(documents, prose):
    """Recall against all pairs that share a shingle, bands or not: texts with and without repeated lines."""
    rng = np.random.default_rng(11)
    texts = []
    for group in range(25):
        base = prose(int(rng.integers(30, 250)), 100 + group, 3000)
        line = prose(9, 500 + group, 3000)
        for copy in range(6):
            words = _edited(base, set(rng.permutation(len(base))[: int(rng.integers(0, 6))].tolist()), f"c{copy}")
            texts.append(" ".join(words + line * int(rng.integers(0, 5)) * (group % 2)))
    sets = _sets(texts)
    found = {r.doc_id: r.class_id for r in near_dedup.classes(documents(list(enumerate(texts)))).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if set(sets[i][0].tolist()) & set(sets[j][0].tolist()) and _similar(sets[i][:2], sets[j][:2])]
    assert len(pairs) > 50 and [p for p in pairs if found[p[0]] != found[p[1]]] == []


@pytest.mark.parametrize("step", [50, 1 << 22])
def test_blocks_count_like_single_pairs(prose, monkeypatch, step):
    monkeypatch.setattr(near_dedup, "STEP", step)
    rng = np.random.default_rng(12)
    base = prose(120, 1, 500)
    texts = [" ".join(_edited(base, set(rng.permutation(120)[: int(rng.integers(0, 9))].tolist()), f"k{k}") + base[:20] * int(rng.integers(0, 3))) for k in range(40)]
    parts = [s[:2] for s in _sets(texts)]
    hubs = near_dedup._Sets(parts[:15])
    hubs.index()
    found = {(int(i), int(j)) for x, y in near_dedup._Sets(parts[15:]).similar_to(hubs) for i, j in zip(x, y)}
    assert found == {(i, j) for i in range(25) for j in range(15) if _similar(parts[15 + i], parts[j])} and 0 < len(found) < 25 * 15


def test_blocks_of_many_parts_and_freed_tables(spark, documents, prose, monkeypatch, tmp_path):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 7)
    base = prose(100, 9, 10_000)
    rng = np.random.default_rng(13)
    texts = [" ".join(_edited(base, set(rng.permutation(100)[:3].tolist()), f"q{k}")) for k in range(80)]
    rows = near_dedup.classes(documents(list(enumerate(texts)))).collect()
    expected = _components(texts)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(expected))
