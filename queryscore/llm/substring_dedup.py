"""Removal of word sequences that occurred earlier, with suffix automata of reference shards.

Windows of ``WINDOW`` words are compared. A window is represented by an anchor, its short word run
with the smallest hash: equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a text is dealt out by anchors and not by windows. The steps:

1. Windows that start earlier in the same document are settled where it is read.
2. The anchors of the remaining windows are counted; those that occur once have no repeat.
3. Stretches of windows under a repeated anchor are joined to it. If all stretches of an anchor are
   equal, the first stays and the others go.
4. Where stretches of an anchor differ (at the ends of copied passages, around edits), one of each
   kind is kept and dealt by anchor into shards of bounded size. A shard builds the suffix automaton
   of its stretches in order of document and start, and streams each stretch through it before adding
   it: a matching statistic of ``WINDOW`` words or more means that the window starts earlier.
   Anchors with very many kinds would fill one shard; their windows are compared one by one by
   hash instead, with the same result.

An automaton goes to the one task that has the stretches it can match, not to all tasks: broadcasting
every shard to every document would be work of corpus times shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscore.llm.scratch import kept
from queryscore.llm.tokens import Words, _GRAM, _GRAM_INVERSE, _span_sums, chunks, mix, words_of

WINDOW = 20
ANCHOR = 8
SHARD_WORDS = 200_000
MANY_KINDS = 2_000

_STRETCH = "anchor long, kind long, doc_id long, digest int, first int, n int"


class Automaton:
    """Suffix automaton of several sequences, each added letter by letter after a reset."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def matching(self, sequence: list[int]) -> Iterator[int]:
        """For each end in ``sequence``, the length of the longest run ending there that was added before."""
        state, length = 0, 0
        next_, link, lengths = self.next, self.link, self.length
        for letter in sequence:
            while state and letter not in next_[state]:
                state = link[state]
                length = lengths[state]
            if letter in next_[state]:
                state = next_[state][letter]
                length += 1
            yield length

    def _clone(self, p: int, letter: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(letter) == q:
            self.next[p][letter] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for letter in sequence:
            q = self.next[last].get(letter)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, letter, q)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and letter not in self.next[p]:
                self.next[p][letter] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][letter]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, letter, q)
            last = new


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, repeated) of all windows; repeated if it starts earlier in the same document."""
    hashes, at = words.grams(WINDOW)
    doc = np.searchsorted(words.offsets, at, "right") - 1
    order = np.argsort(hashes, kind="stable")  # equal ones stay in order of document and place
    h, d = hashes[order], doc[order]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:]] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return at, hashes, repeated


def anchors(words: Words, at: np.ndarray) -> np.ndarray:
    """The smallest hash among the runs of ``ANCHOR`` words inside each window."""
    starts = np.arange(max(len(words.hashes) - ANCHOR + 1, 0))
    runs = _span_sums(words.hashes, starts, starts + ANCHOR, _GRAM, _GRAM_INVERSE)
    least, width, span = runs, 1, WINDOW - ANCHOR + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    return least[at] if len(at) else np.zeros(0, np.uint64)


def stretches(words: Words, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, kind, document, first, n) of runs of kept windows with one anchor; kind hashes their words."""
    at = at[keep]
    anchor = anchors(words, at)
    doc = np.searchsorted(words.offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    a = at[first]
    kind = mix(_span_sums(words.hashes, a, a + n + WINDOW - 1, _GRAM, _GRAM_INVERSE) + n.astype(np.uint64))
    return anchor[first], kind, doc[first], a - words.offsets[doc[first]], n


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, behind, data, bounds in chunks(batch.column("text")):
            words = words_of(data, bounds)
            at, _, repeated = windows(words)
            anchor, kind, doc, start, n = stretches(words, at, ~repeated)
            who = batch.slice(first, behind - first).select(["doc_id", "digest"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), *who.columns,
                pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
            ], names=["anchor", "kind", "doc_id", "digest", "first", "n"])


def _automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and place; each gives the windows of it that start earlier in its shard."""
    shard, automaton = None, None
    for batch in batches:
        rows, firsts, counts = [], [], []
        for i, (s, n, sequence) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "words")))):
            if s != shard:
                shard, automaton = s, Automaton()
            run = -1
            for end, length in enumerate(automaton.matching(sequence)):
                if length >= WINDOW and run < 0:
                    run = end - WINDOW + 1
                elif length < WINDOW and run >= 0:
                    rows.append(i), firsts.append(run), counts.append(end - WINDOW + 1 - run)
                    run = -1
            if run >= 0:
                rows.append(i), firsts.append(run), counts.append(n - run)
            automaton.add(sequence)
        who = batch.select(["doc_id", "digest", "first"]).take(pa.array(rows, pa.int64()))
        start = who.column("first").to_numpy(zero_copy_only=False) + np.array(firsts, np.int64)
        yield pa.RecordBatch.from_arrays([
            *who.select(["doc_id", "digest"]).columns, pa.array(start.astype(np.int32)), pa.array(np.array(counts, np.int32)),
        ], names=["doc_id", "digest", "first", "n"])


def _wordy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch to compare, with the hashes of its words and of its windows."""
    names = ["anchor", "many", "doc_id", "digest", "first", "n", "words", "windows"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        events, ids, digests = (batch.column(c).to_pylist() for c in ("events", "doc_id", "digest"))
        for first, behind, data, bounds in chunks(batch.column("text")):
            words = words_of(data, bounds)
            hashes, at = words.grams(WINDOW)
            out = []
            for i in range(first, behind):
                for want in events[i]:
                    if want["anchor"] is not None:
                        a, n = int(words.offsets[i - first]) + want["first"], want["n"]
                        w = int(np.searchsorted(at, a))
                        out.append((
                            want["anchor"], want["many"], ids[i], digests[i], want["first"], n,
                            words.hashes[a : a + n + WINDOW - 1].view(np.int64).tolist(), hashes[w : w + n].view(np.int64).tolist(),
                        ))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _results(words: Words, bounds: np.ndarray, lost: np.ndarray) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) per document; ``lost`` marks words."""
    stay = np.flatnonzero(~lost)
    owner = np.searchsorted(words.offsets, stay, "right") - 1
    starts, ends = words.starts[stay], words.ends[stay]
    # the byte behind a kept word becomes the space before the next one of its document
    spaced = np.zeros(len(stay), bool)
    spaced[:-1] = owner[1:] == owner[:-1]
    data = words.data.copy()
    data[ends[spaced]] = 0x20
    edge = np.zeros(len(data) + 2, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends + spaced, -1)
    picked = np.cumsum(edge)[: len(data)] > 0
    at = np.append(0, np.cumsum(picked))[bounds]
    text = memoryview(data[picked])
    gone = np.append(0, np.cumsum(lost))[words.offsets]
    return [
        (int(words.counts[i]), int(gone[i + 1] - gone[i]), hashlib.sha256(text[at[i] : at[i + 1]]).hexdigest())
        for i in range(len(words.counts))
    ]


def _covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """The words that windows at these starts cover."""
    edge = np.zeros(n_words + WINDOW + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge)[:n_words] > 0


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each document from its own repeats and its lists of spans (windows from first on)."""
    names = ["doc_id", "digest", "n_words", "n_removed", "kept_sha256"]
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in ("events", "spans") if c in batch.schema.names]
        for first, behind, data, bounds in chunks(batch.column("text")):
            words = words_of(data, bounds)
            at, _, repeated = windows(words)
            starts = [at[repeated]]
            for spans in lists:
                for i in range(first, behind):
                    for x in spans[i] or ():
                        if x.get("anchor") is None:
                            a = int(words.offsets[i - first]) + x["first"]
                            starts.append(np.arange(a, a + x["n"]))
            rows = _results(words, bounds, _covered(len(words.hashes), np.concatenate(starts)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                *batch.slice(first, behind - first).select(["doc_id", "digest"]).columns,
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
            ], names=names)


_RESULT = "doc_id long, digest int, n_words long, n_removed long, kept_sha256 string"


def _place():
    """Ordered like the documents: a null id is last, equal ids go by their texts."""
    return [F.col("doc_id").isNull().alias("null"), "doc_id", "digest", "first"]


def _with(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to ``other``, which has one row per (doc_id, digest)."""
    other = other.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(other, on, how).drop("_id", "_digest")


def _compared(asked: DataFrame, stretches_: DataFrame) -> DataFrame:
    """(doc_id, digest, first, n): windows of the stretches that start earlier under the same anchor."""
    wordy = asked.where(F.exists("events", lambda e: e["anchor"].isNotNull())).select("doc_id", "digest", "text", "events").mapInArrow(
        _wordy, "anchor long, many boolean, doc_id long, digest int, first int, n int, words array<long>, windows array<long>"
    )
    total = stretches_.where(~F.col("many")).agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0
    shards = int(total // SHARD_WORDS) + 1
    dealt = wordy.where(~F.col("many")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = dealt.select("shard", "doc_id", "digest", "first", "n", "words").repartition(max(shards, 2), "shard")
    found = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "digest", "first").mapInArrow(
        _automata, "doc_id long, digest int, first int, n int"
    )
    single = kept(wordy.where("many").select("doc_id", "digest", "first", F.posexplode("windows").alias("k", "window")).select(
        "doc_id", "digest", (F.col("first") + F.col("k")).alias("first"), "window"
    ), "windows")
    heads = kept(
        single.groupBy("window").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*_place())).alias("head")).where("_n > 1").drop("_n"), "heads"
    )
    later = single.join(heads, "window").where(F.struct(*_place()) != F.col("head"))
    return found.unionByName(later.select("doc_id", "digest", "first", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``.

    A word goes if a window of ``WINDOW`` words covers it whose words also start earlier: in a
    smaller doc_id (a null id is the largest, equal ids go by a hash of the text) or earlier in the
    same text. Rows equal in id and text are one document and have equal results. Null and blank
    texts and texts shorter than a window lose nothing.
    """
    texts = docs.select("doc_id", F.hash("text").alias("digest"), "text")
    alone = kept(texts.mapInArrow(_finished, _RESULT), "alone")
    dealt = texts.mapInArrow(_dealt, _STRETCH)
    repeated = kept(dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor"), "anchors")
    shared = kept(dealt.join(repeated, "anchor"), "stretches")
    kinds = kept(shared.groupBy("anchor", "kind").agg(F.min(F.struct(*_place(), "n")).alias("head"), F.count(F.lit(1)).alias("rows")), "kinds")
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1")
    mixed = kept(kinds.join(many, "anchor").select(
        F.col("head.doc_id"), F.col("head.digest"), F.col("head.first"), F.col("head.n"), "anchor", (F.col("_kinds") > MANY_KINDS).alias("many")
    ), "mixed")
    later = shared.join(kinds.where("rows > 1").select("anchor", "kind", "head"), ["anchor", "kind"]).where(
        F.struct(*_place(), "n") != F.col("head")
    ).select("doc_id", "digest", "first", "n", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("boolean").alias("many"))
    events = later.unionByName(mixed).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "n", "anchor", "many")).alias("events"))
    asked = kept(_with(texts, kept(events, "events"), "inner").dropDuplicates(["doc_id", "digest"]), "asked")
    spans = _compared(asked, mixed).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    fixed = _with(asked, kept(spans, "spans"), "left").mapInArrow(_finished, _RESULT)
    fixed = kept(fixed, "fixed").withColumnsRenamed({c: f"_{c}" for c in ("n_words", "n_removed", "kept_sha256")})
    return _with(alone, fixed, "left").select(
        "doc_id", "n_words", F.coalesce("_n_removed", "n_removed").alias("n_removed"),
        F.coalesce("_kept_sha256", "kept_sha256").alias("kept_sha256"),
    )
