import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from queryscore.llm.tokens import NOT_ALNUM, chunks, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\ré😀-1", max_size=30)), max_size=8)


def _pieces(texts, limit, separator=None):
    names = {}
    for first, behind, data, bounds in chunks(pa.array(texts, pa.string()), limit):
        words = words_of(data, bounds) if separator is None else words_of(data, bounds, separator)
        for i in range(first, behind):
            own = slice(words.offsets[i - first], words.offsets[i - first + 1])
            found = [bytes(data[a:b]).decode() for a, b in zip(words.starts[own], words.ends[own])]
            yield i, found, words.hashes[own].tolist()
    assert names == {}


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_words_are_those_of_the_pattern_for_any_chunk_size(texts, limit):
    names = {}
    for i, found, hashes in _pieces(texts, limit):
        assert found == re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        for word, h in zip(found, hashes):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_normalised_words_hold_letters_and_digits(texts):
    for i, found, _ in _pieces(texts, 1 << 20, NOT_ALNUM):
        assert found == re.findall(r"[a-z0-9\x80-\U0010ffff]+", texts[i] or "")


def test_grams_stay_inside_documents_and_do_not_depend_on_place():
    data = np.frombuffer(b"a b c d a b c", np.uint8)
    words = words_of(data, np.array([0, 7, 13]))
    grams, at = words.grams(3)
    assert at.tolist() == [0, 1, 4] and grams[0] == grams[2] != grams[1]
    assert len(words.grams(9)[0]) == 0
