import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queryscore.llm import substring_dedup


def _brute(docs):
    digest = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.hash("text").alias("h")).collect()}
    order = sorted(digest, key=lambda x: (x[0] is None, x[0] or 0, digest[x]))
    words = {x: re.findall(r"[^\x20\x09-\x0D]+", x[1] or "") for x in order}
    first = {}
    for x in order:
        for i in range(len(words[x]) - 19):
            first.setdefault(tuple(words[x][i : i + 20]), (x, i))
    out = {}
    for x in order:
        w = words[x]
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (x, i) for j in range(i, i + 20)}
        kept = " ".join(t for j, t in enumerate(w) if j not in gone)
        out[x] = (x[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter(out[r.doc_id, r.text] for r in docs.collect())


@pytest.mark.parametrize("many, shard", [(2_000, 200_000), (1, 200_000), (3, 100)])
def test_equals_brute_force(documents, prose, monkeypatch, many, shard):
    monkeypatch.setattr(substring_dedup, "MANY_KINDS", many)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rng = random.Random(1)
    passages = [prose(n, 50 + n) for n in (15, 20, 21, 30, 60, 200)]
    rows = []
    for i in range(60):
        words = prose(rng.randrange(0, 60), i)
        for p in rng.sample(passages, rng.randrange(0, 4)):
            a = rng.randrange(0, 5)
            words += p[a:] + prose(rng.randrange(0, 5), i + 1000)
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(words)))
    w = prose(200, 9)
    rows += [
        (-1, None), (-2, ""), (-3, " ".join(w)), (-4, " ".join(w[50:90] + ["q"] + w[10:60] + w[10:60])), (-5, " ".join(["a"] * 100)),
        (-6, "\tx \n" + " ".join(["a"] * 50)), (None, " ".join(w[100:150])), (900, " ".join(w[105:145] + ["é"] * 30)),
        (900, " ".join(w[105:145] + ["é"] * 30)), (900, " ".join(w[100:150])), (901, " ".join(w[:19])), (902, " ".join(prose(30_000, 3, 50))),
    ]
    docs = documents(rows)
    found = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == _brute(docs)


def test_automaton_gives_matching_statistics():
    rng = random.Random(4)
    for _ in range(50):
        automaton, added = substring_dedup.Automaton(), []
        for _ in range(5):
            text = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
            for end, length in enumerate(automaton.matching(text)):
                runs = [n for n in range(end + 2) if any(text[end + 1 - n : end + 1] == a[i : i + n] for a in added for i in range(len(a) - n + 1)) or n == 0]
                assert length == max(runs)
            automaton.add(text)
            added.append(text)


def test_empty_table(documents):
    assert substring_dedup.remove_repeats(documents([])).count() == 0
