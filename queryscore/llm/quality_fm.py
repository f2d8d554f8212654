"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs are never formed: for each
factor their sum is half of (sum v_i x_i)^2 - sum (v_i x_i)^2, so a text is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscore.llm.native import free_name
from queryscore.llm.sample import fit_in_task, fold, labelled_sample
from queryscore.llm.tokens import Words, chunks, words_of

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
SAMPLE_ROWS = 8_000
SEED = 6

BUCKETS = 1 << 15
FACTORS = 4
EPOCHS = 20
BATCH = 128
RATE = 0.2
RIDGE = 1e-5

STATISTICS = (
    "log_words", "log_bytes", "bytes_per_word", "longest_word", "upper_share", "digit_share", "symbol_share",
    "mark_share", "bar_share", "other_byte_share", "words_per_line", "distinct_share", "repeat_share", "same_as_next_share",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=_{}[]\\/+`", b"!?", b"|", bytes(range(128, 256)), b"\n",
), 1):
    _CLASS[list(_chars)] = _k
_CLASSES = 8


def statistics(words: Words, bounds: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per document."""
    n_docs, n = len(words.counts), words.counts
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), sizes)
    classes = np.bincount(doc * _CLASSES + _CLASS[words.data], minlength=n_docs * _CLASSES).reshape(n_docs, _CLASSES)
    of_word = np.repeat(np.arange(n_docs), n)
    lengths = words.ends - words.starts
    longest = np.zeros(n_docs)
    np.maximum.at(longest, of_word, lengths)
    letters = np.bincount(of_word, lengths, n_docs)

    def distinct(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, owner))
        h, d = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n_docs)

    grams, at = words.grams(3)
    n_grams = np.maximum(n - 2, 0)
    same = np.zeros(len(of_word), bool)
    same[:-1] = (words.hashes[1:] == words.hashes[:-1]) & (of_word[1:] == of_word[:-1])
    one = lambda x: np.maximum(x, 1)
    return np.stack([
        np.log1p(n), np.log1p(sizes), letters / one(n), np.log1p(longest),
        *[classes[:, k] / one(sizes) for k in (1, 2, 3, 4, 5, 6)], np.log1p(n / (classes[:, 7] + 1)),
        distinct(words.hashes, of_word) / one(n), 1 - distinct(grams, of_word[at]) / one(n_grams) if len(grams) else np.zeros(n_docs),
        np.bincount(of_word[same], minlength=n_docs) / one(n),
    ], axis=1)


@dataclass
class Rows:
    """Sparse rows: row ``i`` has features ``at[offsets[i]:offsets[i + 1]]`` of value ``x``; ``stats`` are dense."""

    at: np.ndarray
    x: np.ndarray
    offsets: np.ndarray
    stats: np.ndarray


def rows_of(words: Words, bounds: np.ndarray) -> Rows:
    """Each different word of a text counts the root of its share of the words, so a text has length 1."""
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    both, count = np.unique(doc * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    doc = both // BUCKETS
    x = np.sqrt(count / words.counts[doc]) if len(both) else np.zeros(0)
    return Rows(both % BUCKETS, x, np.searchsorted(doc, np.arange(len(words.counts) + 1)), statistics(words, bounds))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Model:
    bias: float
    w: np.ndarray  # words, then statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(len(STATISTICS))

    def parts(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score before the sigmoid, factor sums, standardised statistics)."""
        s = self.dense(rows.stats)
        ws, vs = self.w[BUCKETS:], self.v[BUCKETS:]
        vx = self.v[rows.at] * rows.x[:, None]
        sums = _sums(vx, rows.offsets) + s @ vs
        squares = _sums(vx**2, rows.offsets) + s**2 @ vs**2
        linear = _sums(self.w[rows.at] * rows.x, rows.offsets) + s @ ws
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, s

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(rows)[0], -30, 30)))


def _take(rows: Rows, which: np.ndarray) -> Rows:
    counts = rows.offsets[which + 1] - rows.offsets[which]
    offsets = np.append(0, np.cumsum(counts))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(rows.offsets[which], counts)
    return Rows(rows.at[at], rows.x[at], offsets, rows.stats[which])


def train_on(rows: Rows, labels: np.ndarray, seed: int = SEED) -> Model:
    """Adagrad on the log loss; a sample with one label only gives its (smoothed) share as every score."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    size = BUCKETS + len(STATISTICS)
    scale = rows.stats.std(axis=0)
    model = Model(
        float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)),
        rows.stats.mean(axis=0), np.where(scale > 1e-9, scale, 1.0),
    )
    if not 0 < labels.sum() < len(labels):
        return model
    model.v = rng.normal(0, 0.05, (size, FACTORS))
    g_bias, g_w, g_v = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            which = order[k : k + BATCH]
            part = _take(rows, which)
            z, sums, s = model.parts(part)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[which]) / len(which)
            of = np.repeat(np.arange(len(which)), np.diff(part.offsets))
            used, back = np.unique(part.at, return_inverse=True)
            ex = error[of] * part.x
            dw = np.bincount(back, ex, len(used)) + RIDGE * model.w[used]
            dv = np.stack([
                np.bincount(back, ex * sums[of, f], len(used)) - np.bincount(back, ex * part.x, len(used)) * model.v[used, f]
                for f in range(FACTORS)
            ], axis=1) + RIDGE * model.v[used]
            es = error[:, None] * s
            dws = es.sum(axis=0)
            dvs = es.T @ sums - (es * s).sum(axis=0)[:, None] * model.v[BUCKETS:]
            used = np.concatenate([used, np.arange(BUCKETS, size)])
            dw, dv, db = np.concatenate([dw, dws]), np.concatenate([dv, dvs]), error.sum()
            g_bias, g_w[used], g_v[used] = g_bias + db**2, g_w[used] + dw**2, g_v[used] + dv**2
            model.bias -= RATE * db / np.sqrt(g_bias)
            model.w[used] -= RATE * dw / np.sqrt(g_w[used])
            model.v[used] -= RATE * dv / np.sqrt(g_v[used])
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, words with their values, statistics): what training needs of a text, of bounded size."""
    for batch in batches:
        for first, behind, data, bounds in chunks(batch.column("text")):
            rows = rows_of(words_of(data, bounds), bounds)
            out = []
            for i in range(behind - first):
                own = slice(rows.offsets[i], rows.offsets[i + 1])
                out.append({
                    "label": batch.column("label")[first + i].as_py(), "at": rows.at[own].tolist(),
                    "x": rows.x[own].tolist(), "stats": rows.stats[i].tolist(),
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("label", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("stats", pa.list_(pa.float64())),
            ]))


def _train(table: pa.Table) -> Model:
    at = table["at"].combine_chunks()
    counts = at.value_lengths().to_numpy(zero_copy_only=False)
    rows = Rows(
        at.flatten().to_numpy().astype(np.int64), table["x"].combine_chunks().flatten().to_numpy(),
        np.append(0, np.cumsum(counts)), np.array(table["stats"].to_pylist(), float).reshape(len(table), len(STATISTICS)),
    )
    return train_on(rows, np.array(table["label"].to_pylist(), float))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, rows, SEED)
    featured = sample.mapInArrow(_featured, "label int, at array<int>, x array<double>, stats array<double>")
    size = BUCKETS + len(STATISTICS)
    return fit_in_task(featured, _train) or Model(
        0.0, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    )


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` and score (0 to 1) of every whole text; a null text is an empty one."""
    carry = [c for c in carry if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("score", T.DoubleType())])
    text = free_name(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                model.scores(rows_of(words_of(data, bounds), bounds)) for _, _, data, bounds in chunks(batch.column(text))
            ]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.select(carry).columns, pa.array(scores)], names=[*carry, "score"])

    return docs.select(*carry, docs["text"].alias(text)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` with held_out, score and predicted of every document; doc_id must be carried."""
    scored = score(docs, learn(docs, labels), carry)
    return scored.withColumns({
        "held_out": fold("doc_id", FOLDS) == HELD_OUT, "predicted": (F.col("score") >= THRESHOLD).cast("int"),
    })


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns (score is replaced if there)."""
    model = learn(docs, labels)
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), docs["text"])
    good = score(packed, model, ["_doc"]).where(F.col("score") >= THRESHOLD)
    return good.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
