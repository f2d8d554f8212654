import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from queryscore.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _rebuilt(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def _plain(sequences):
    """The trie by brute force: rows as the operator returns them."""
    members = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in under)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        ends = ",".join(map(str, sorted(c for c in convs if len(sequences[c]) == len(node))))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def _rows(seed, convs=60, most=7, words="abcd"):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice([*words, "é" * 3, None]) if rng.random() < 0.5 else words[0]))
    return rows


@pytest.mark.parametrize("container", [2, 1000])
def test_shared_prefixes_equal_brute_force(spark, container):
    rows = _rows(1) + [(200 + i, t, "user", f"hot {t}") for i in range(40) for t in range(4)]
    rows += [(300, None, "user", "a"), (300, None, "user", "b"), (300, 1, "user", "b"), (300, 1, "user", "b"), (None, 1, "user", "x")]
    rows += [(-3, 0, "user", "a"), (-7, 1, "", "a"), (1001, 0, "user", "x" * 300_000), (1002, 5, "user", "x" * 300_000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _found(prefix_trie.shared_prefixes(table, container)) == _plain(_rebuilt(rows))


@pytest.mark.parametrize("container", [1, 3, 50])
def test_conversations_of_many_segments(spark, monkeypatch, container):
    """Segments and blocks of two: every rule for long conversations is met."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 2)
    monkeypatch.setattr(prefix_trie, "_BLOCK", 2)
    rng = random.Random(4)
    sequences = {c: [("r", rng.choice("ab") if d > 2 * (c % 4) else "a") for d in range(rng.randrange(0, 14))] for c in range(30)}
    sequences |= {50: [("r", "a")] * 25, 51: [("r", "a")] * 25, 52: [("r", "a")] * 24 + [("r", "c")], 53: []}
    rows = [(c, d + 1, hashlib.md5(t.encode()).hexdigest(), len(t), len(seq)) for c, seq in sequences.items() for d, (_, t) in enumerate(seq)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, id string, size long, length long")
    convs = spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv_id long, length long")
    assert _found(prefix_trie.trie(turns, convs, container)) == _plain(sequences)


def test_empty_table_turnless_conversations_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert _found(prefix_trie.shared_prefixes(empty)) == []
    # h of 1 is 4, the base 0 is not there: nothing is left
    rows = [(1, 0, "user", "x")]
    assert _found(prefix_trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == _plain(_rebuilt(rows)) == [
        (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    rows = _rows(7, 12)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("p"), "place": F.lit(3), "task": F.lit(1), "any": F.lit(1), "id": F.lit(0)})
    assert _found(prefix_trie.shared_prefixes(wide)) == _plain(_rebuilt(rows))


def test_one_long_conversation_is_numbered_across_tasks(spark):
    rows = spark.range(20_000).select(F.lit(5).cast("bigint").alias("conv_id"), (F.col("id") * 7 % 20_000).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    found = prefix_trie.turns(rows.repartition(8))
    assert found.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (20_000, 1, 20_000)


def test_digest_of_many_members_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PART_BYTES", 100)
    members = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("key"), F.col("id").alias("conv_id"))
    want = {k: hashlib.sha256(",".join(str(i) for i in range(5000) if (i % 3 == 0) == (k == "a")).encode()).hexdigest() for k in "ab"}
    assert {r.cid: r.ends_sha256 for r in prefix_trie.id_digests(members.repartition(7)).collect()} == want
