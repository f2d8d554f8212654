import re
from collections import Counter

from queryscore.llm import decision_list


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "a", "a b", "a b c a b c", "x x x x x", "a b\na b\n\n \nA b", "é😀 # ** <p> |", "a b c d a b c e a b",
    "one\x0btwo\x0cthree\rfour " * 20, "p q r " * 3000, "\n".join(["same line here"] * 40),
]


def test_statistics_match_a_plain_count(documents):
    rows = decision_list.statistics(documents(list(enumerate(TEXTS))), ["doc_id"]).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute(TEXTS[r.doc_id]), r.doc_id


def test_rules_are_learned_pruned_and_applied(spark, documents, prose):
    rows, labels = [], []
    for i in range(240):
        words = prose(80, i, 5000)
        bad = i % 4 == 0
        if bad:
            words = [w + "###" if i % 8 else w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, " ".join(prose(80, 1000, 5000))), (1001, None), (1002, "short"), (1002, "short")]
    labels += [(5, 1), (None, 0), (2000, 1), (1001, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {}
    for r in decision_list.apply_rules(documents(rows), labels, ["doc_id"]).collect():
        found.setdefault(r.doc_id, r)
    assert all(found[i].kept for i in range(240) if i % 4)
    assert sum(not found[i].kept for i in range(0, 240, 4)) >= 54  # of 60; a rule needs rows enough to be pruned on
    assert found[1000].kept and found[1000].rule is None
    assert found[1001].base_failed and not found[1001].kept and found[1002].base_failed
    assert {found[i].rule for i in range(0, 240, 4)} - {None} <= {1, 2, 3}


def test_no_labels_no_rules_and_empty_tables(spark, documents, prose):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = decision_list.apply_rules(documents([(1, " ".join(prose(80, 1, 5000)))]), none, ["doc_id"]).collect()
    assert [r.kept for r in rows] == [True]
    assert decision_list.apply_rules(documents([]), none, ["doc_id"]).count() == 0
    clash = spark.createDataFrame([(1, "a b", 99, True)], "doc_id long, text string, n_words int, other boolean")
    row = decision_list.apply_rules(clash, none, clash.columns).first()
    assert row.n_words == 2 and row.other
