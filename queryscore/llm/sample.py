"""Labelled samples of bounded size and models that travel as bytes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore.llm.native import one_label


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % folds, F.lit(0).cast("bigint"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, rows: int, seed: int) -> DataFrame:
    """(label, text) of the documents of at most ``rows`` labelled ids, the first by a hash of the id.

    The ids are the only thing broadcast: ``rows`` of them at most.
    """
    ids = one_label(labels, label).where(may_learn)
    some = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text")


def fit_in_task(rows: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """The model that ``train`` makes of the sample, in one task; a sample has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            model = pickle.dumps(train(pa.Table.from_batches(batches)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None
