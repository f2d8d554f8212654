import os
import random

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def importable(spark):
    """Python workers find the package wherever pytest was started."""
    spark.sparkContext.environment["PYTHONPATH"] = REPO


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture
def prose():
    """Random words; the same seed gives the same words."""

    def make(n, seed, vocabulary=400):
        rng = random.Random(seed)
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]

    return make
