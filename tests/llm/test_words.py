from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fundtrace.llm import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é漢.,\n\t|", max_size=60)), max_size=12)


def expected(text, pattern):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(pattern, text or "")]


@pytest.mark.parametrize("block", [8, 1 << 20])
@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_match_a_regular_expression(block, rows):
    before, words.BLOCK = words.BLOCK, block
    try:
        found = words.Words(pa.array(rows, pa.string()))
    finally:
        words.BLOCK = before
    names = {}
    for i, text in enumerate(rows):
        own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
        want = expected(text, r"[^\x20\x09-\x0D]+")
        assert len(own) == len(want)
        for w, h in zip(want, own):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_windows_stay_within_rows():
    found = words.Words(pa.array(["a b c", "d e", "", "f g h i"]))
    grams, inside = found.windows(3)
    assert len(grams) == 7 and inside.sum() == 3
    assert len(set(grams[inside].tolist())) == 3


def test_prefixes():
    found = words.Words(pa.array(["abcdef abcdxy ab"]), prefixes=(4,))
    p = found.prefixes[0]
    assert p[0] == p[1] != p[2]
    assert found.hashes[0] != found.hashes[1]


def test_sliced_column():
    column = pa.array(["x", "one two", "three", None])[1:3]
    found = words.Words(column)
    assert np.diff(found.bounds).tolist() == [2, 1]
