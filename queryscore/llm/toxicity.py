"""Toxicity by a logistic classifier that identity terms may not sway.

Features are the words of a text and the beginnings of its words (inflected forms share them),
each present or not. Those that labelled documents show to matter are kept. While the weights are
fitted, identity terms of the labelled texts are swapped for others, and for none, and every change
of the score that this makes is penalised: a group's mention alone neither raises nor lowers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore.llm.native import free_name
from queryscore.llm.sample import fit_in_task, fold, labelled_sample
from queryscore.llm.tokens import _BASE, _BASE_INVERSE, NOT_ALNUM, Words, _span_sums, chunks, mix, words_of

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE_ROWS = 16_000
SEED = 5

PREFIX_BYTES = (3, 4, 5, 6)
MIN_DOCUMENTS = 4
MIN_SIGNAL = 12.0
MAX_FEATURES = 4000
ROUNDS = 400
RATE = 0.05
RIDGE = 1e-4
COUNTERFACTUAL = 1.0

#: Terms for groups of people; a term is swapped for the next one of its row, and for nothing.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"), ("disabled", "blind", "deaf", "autistic"),
    ("old", "young"), ("americans", "mexicans", "chinese", "indians", "germans", "french"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("ausländer", "flüchtlinge", "bürger"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("étrangers", "réfugiés", "citoyens"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"), ("extranjeros", "refugiados", "ciudadanos"), ("negros", "blancos"),
)
_NEXT = {term: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, term in enumerate(row)}
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")(?!\w)")


def swapped(text: str) -> tuple[str, str] | None:
    """A lower-case text with its identity terms swapped and without them; None if it has none."""
    if not _TERM.search(text):
        return None
    return _TERM.sub(lambda m: _NEXT[m[0]], text), _TERM.sub("", text)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash), each once per document."""
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    # words of a chunk repeat: their beginnings are hashed once each
    whole, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, ends = words.starts[first], words.ends[first]
    data = words.data.astype(np.uint64) + np.uint64(1)
    kinds = [whole]
    for n in PREFIX_BYTES:
        kinds.append(mix(_span_sums(data, starts, np.minimum(ends, starts + n), _BASE, _BASE_INVERSE) ^ np.uint64(n)))
    return doc, np.stack(kinds)[:, back]


def _present(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, index) of the known features in each document, each pair once."""
    doc, hashes = _features(words)
    pairs = []
    for kind in hashes:
        at = np.minimum(np.searchsorted(known, kind), len(known) - 1)
        hit = known[at] == kind
        pairs.append(doc[hit] * len(known) + at[hit])
    both = np.unique(np.concatenate(pairs))
    return both // len(known), both % len(known)


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, words: Words) -> np.ndarray:
        out = np.full(len(words.counts), self.bias)
        if len(self.known) and len(words.hashes):
            doc, at = _present(words, self.known)
            out += np.bincount(doc, self.weights[at], len(out))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _words(texts: pa.Array) -> Iterator[Words]:
    for _, _, data, bounds in chunks(texts):
        yield words_of(data, bounds, NOT_ALNUM)


def _chosen(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """The features whose share differs most between toxic and other documents, by a chi-square of one degree."""
    seen = []
    done = 0
    for words in _words(pa.array(texts, pa.large_string())):
        doc, hashes = _features(words)
        for kind in hashes:
            order = np.lexsort((doc, kind))
            kind_, doc_ = kind[order], doc[order] + done
            new = np.ones(len(order), bool)
            new[1:] = (kind_[1:] != kind_[:-1]) | (doc_[1:] != doc_[:-1])
            values, at = np.unique(kind_[new], return_inverse=True)
            seen.append((values, np.bincount(at, minlength=len(values)), np.bincount(at, labels[doc_[new]], len(values))))
        done += len(words.counts)
    if not seen:
        return np.zeros(0, np.uint64)
    values, at = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
    n = np.bincount(at, np.concatenate([s[1] for s in seen]), len(values))
    toxic = np.bincount(at, np.concatenate([s[2] for s in seen]), len(values))
    share = labels.mean()
    signal = (toxic - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9) / np.maximum(1 - n / len(labels), 1e-9)
    signal[n < MIN_DOCUMENTS] = 0
    best = np.argsort(-signal, kind="stable")[:MAX_FEATURES]
    return np.sort(values[best[signal[best] >= MIN_SIGNAL]])


def _matrix(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    docs, ats, done = [], [], 0
    for words in _words(pa.array(texts, pa.large_string())):
        doc, at = _present(words, known)
        docs.append(doc + done)
        ats.append(at)
        done += len(words.counts)
    return np.concatenate(docs), np.concatenate(ats)


def train_on(texts: list[str], labels: np.ndarray, strength: float = COUNTERFACTUAL) -> Model:
    """Fit on lower-case texts; a sample with one label only gives its (smoothed) share as every score."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    known = _chosen(texts, labels) if 0 < labels.sum() < len(labels) else np.zeros(0, np.uint64)
    bias = float(np.log(share / (1 - share)))
    if not len(known):
        return Model(known, np.zeros(0), bias)
    doc, at = _matrix(texts, known)
    n, f = len(texts), len(known)
    # counterfactuals: rows of feature differences, text with terms swapped or left out minus text
    originals, variants = [], []
    for i, text in enumerate(texts):
        for other in swapped(text) or ():
            originals.append(i)
            variants.append(other)
    if variants:
        v_doc, v_at = _matrix(variants, known)
        own = {i: at[doc == i] for i in set(originals)}
        o_doc = np.concatenate([np.full(len(own[i]), k) for k, i in enumerate(originals)])
        o_at = np.concatenate([own[i] for i in originals])
        d_doc, d_at = np.concatenate([v_doc, o_doc]), np.concatenate([v_at, o_at])
        d_sign = np.concatenate([np.ones(len(v_at)), -np.ones(len(o_at))])
    w, m, s = np.zeros(f + 1), np.zeros(f + 1), np.zeros(f + 1)
    w[-1] = bias
    for step in range(1, ROUNDS + 1):
        z = np.bincount(doc, w[at], n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        slope = np.append(np.bincount(at, error[doc], f) + RIDGE * w[:-1], error.sum())
        if variants:
            change = np.bincount(d_doc, d_sign * w[d_at], len(variants))
            slope[:-1] += 2 * strength / len(variants) * np.bincount(d_at, d_sign * change[d_doc], f)
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(known, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, rows, SEED)

    def train(table: pa.Table) -> Model:
        return train_on([t or "" for t in table["text"].to_pylist()], np.array(table["label"].to_pylist(), float))

    model = fit_in_task(sample.withColumn("text", F.lower("text")), train)
    return model or Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` and score (0 to 1) of every whole text; a null text is an empty one."""
    carry = [c for c in carry if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("score", T.DoubleType())])
    text = free_name(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(words) for words in _words(batch.column(text))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.select(carry).columns, pa.array(scores)], names=[*carry, "score"])

    return docs.select(*carry, F.lower(docs["text"]).alias(text)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` with doc_id, held_out, score and predicted of every document."""
    scored = score(docs, learn(docs, labels), carry)
    return scored.withColumns({
        "held_out": fold("doc_id", FOLDS) == HELD_OUT, "predicted": (F.col("score") >= THRESHOLD).cast("int"),
    })
