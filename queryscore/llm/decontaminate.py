"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as normalised words (lower case, only letters and digits), so an edit is a word
inserted, dropped or replaced. A test item of ``m`` words may differ by ``budget(m)`` edits and is
split into one piece more than that: a passage within the budget has at least one piece unchanged.
Places where a piece occurs exactly are verified with Myers' bit-parallel distance.

The items go to the tasks in blocks of bounded size, each a pass over the documents; the documents
are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore.llm.native import free_name
from queryscore.llm.tokens import NOT_ALNUM, Words, chunks, words_of

ERROR_SHARE = 0.2
MIN_PIECE = 4
BLOCK_BYTES = 16 << 20
HITS = (("item_id", T.LongType()), ("distance", T.LongType()), ("first_word", T.LongType()), ("end_word", T.LongType()))


def budget(m: int) -> int:
    """Edits allowed for an item of ``m`` words; its pieces have ``MIN_PIECE`` words or more, if it has."""
    return max(0, min(int(m * ERROR_SHARE), m // MIN_PIECE - 1))


def _words(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    for first, _, data, bounds in chunks(texts):
        yield first, words_of(data, bounds, NOT_ALNUM)


class Items:
    """The pieces of a block of test items, by the hash of their first words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.patterns: list[np.ndarray] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        if rows:
            for first, words in _words(pa.array([text for _, text in rows], pa.string())):
                for i, m in enumerate(words.counts):
                    if m:
                        self.ids.append(rows[first + i][0])
                        self.patterns.append(words.hashes[words.offsets[i] : words.offsets[i + 1]])
        for k, pattern in enumerate(self.patterns):
            m, n = len(pattern), budget(len(pattern)) + 1
            cuts = [m * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                key = min(b - a, MIN_PIECE)
                whole = Words(pattern, np.array([0, m]), None, None, None)
                pieces.setdefault(key, []).append((int(whole.grams(key)[0][a]), k, a))
        self.pieces = {
            n: (np.array([h for h, _, _ in found], np.uint64), np.array([k for _, k, _ in found]), np.array([a for _, _, a in found]))
            for n, found in ((n, sorted(found)) for n, found in pieces.items())
        }
        self.masks = [_masks(p) for p in self.patterns]

    def hits(self, words: Words) -> set[tuple[int, int, int]]:
        """(document, item, aligned start of the item relative to the document) of every exact piece."""
        out: set[tuple[int, int, int]] = set()
        for n, (keys, items, offsets) in self.pieces.items():
            grams, at = words.grams(n)
            left = np.searchsorted(keys, grams, "left")
            some = np.flatnonzero((left < len(keys)) & (keys[np.minimum(left, len(keys) - 1)] == grams))
            doc = np.searchsorted(words.offsets, at[some], "right") - 1
            for i, d in zip(some.tolist(), doc.tolist()):
                j = int(left[i])
                while j < len(keys) and keys[j] == grams[i]:
                    out.add((d, int(items[j]), int(at[i] - words.offsets[d] - offsets[j])))
                    j += 1
        return out


def _masks(pattern: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def myers(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to a pattern of ``m`` words; the first end of those."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(diagonal | plus) & full), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (~(vertical | up) & full), up & vertical
        if score < best:
            best, end = score, j
    return best, end


def _matches(items: Items, words: Words) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(document, item) → (distance, first word, end) of the nearest passage within the budget."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, k, start in sorted(items.hits(words)):
        m = len(items.patterns[k])
        allowed = budget(m)
        length = int(words.counts[d])
        a, b = max(0, start - allowed), min(length, start + m + allowed)
        part = words.hashes[words.offsets[d] + a : words.offsets[d] + b].tolist()
        distance, end = myers(items.masks[k], m, part)
        if distance <= allowed:
            # the same distance backwards from the end gives the start
            back, length_back = myers(_masks(items.patterns[k][::-1]), m, part[:end][::-1])
            found = (distance, a + end - length_back, a + end)
            if (d, k) not in best or found < best[d, k]:
                best[d, k] = found
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_BYTES`` of text, or one item."""
    block, held = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", F.lower("text").alias("text")).toLocalIterator():
        size = len(row.text.encode())
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += size
    yield block


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, item_id, distance, first_word and end_word of every document and test item found in it.

    One row per row of ``docs`` and item, with the nearest passage (the first of equals). Null and
    empty texts and items match nothing; items without letters or digits neither. An item of fewer
    than four words is only found unchanged. Columns of ``carry`` with the names of results give way.
    """
    carry = [c for c in carry if c not in dict(HITS)]
    schema = T.StructType([*[docs.schema[c] for c in carry], *[T.StructField(*h) for h in HITS]])
    text = free_name(carry)
    rows = docs.select(*carry, F.lower(docs["text"]).alias(text))
    out = None
    for block in _blocks(benchmark):
        part = rows.mapInArrow(_finder(block, carry, text), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _finder(block, carry, text):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block)
        for batch in batches:
            for first, words in _words(batch.column(text)):
                found = sorted(_matches(items, words).items())
                if found:
                    taken = batch.select(carry).take(pa.array([first + d for (d, _), _ in found]))
                    values = [[items.ids[k] for (_, k), _ in found], *map(list, zip(*[v for _, v in found]))]
                    columns = [*taken.columns, *[pa.array(v, pa.int64()) for v in values]]
                    yield pa.RecordBatch.from_arrays(columns, names=[*carry, *[n for n, _ in HITS]])
    return run


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item; nothing is shuffled."""
    text = free_name(docs.columns)
    for block in _blocks(benchmark):
        docs = docs.withColumn(text, F.lower("text")).mapInArrow(
            _dropper(block, text), T.StructType([*docs.schema.fields])
        )
    return docs


def _dropper(block, text):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, words in _words(batch.column(text)):
                for d, _ in _matches(items, words):
                    clean[first + d] = False
            yield batch.filter(pa.array(clean)).drop_columns([text])
    return run
