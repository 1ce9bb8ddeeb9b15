"""Jaro-Winkler similarity (FN24), the one measure Spark has no built-in for."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX_WEIGHT = 0.1
PREFIX_LIMIT = 4
BOOST_FROM = 0.7

# Least similarity of the two levels below equality.
CLOSE = 0.92
LIKE = 0.82


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a[:PREFIX_LIMIT], b[:PREFIX_LIMIT]):
        if x != y:
            break
        n += 1
    return n


def cannot_reach(a: str, b: str, least: float) -> bool:
    """True if the letters two strings have in common already rule out ``least``."""
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    if not common:
        return True
    bound = (common / len(a) + common / len(b) + 1) / 3
    return bound + _shared_prefix(a, b) * PREFIX_WEIGHT * (1 - bound) < least - 1e-9


def jaro_winkler_pair(a: str, b: str) -> float:
    """Similarity of two strings; the shared-prefix bonus applies above 0.7 only."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    hits_a = []
    for i, char in enumerate(a):
        low = max(i - reach, 0)
        while (j := b.find(char, low, i + reach + 1)) >= 0:
            if free[j]:
                free[j] = False
                hits_a.append(char)
                break
            low = j + 1
    if not hits_a:
        return 0.0
    hits_b = [char for j, char in enumerate(b) if not free[j]]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b)) // 2
    m = len(hits_a)
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if score > BOOST_FROM:
        prefix = _shared_prefix(a, b)
        score += prefix * PREFIX_WEIGHT * (1 - score)
    return score


# Names of up to this many letters are compared in one machine word.
WORD = 64


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one row each, and their lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(int(lengths.max()), 1)
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width), lengths


def jaro_winkler_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``jaro_winkler_pair`` of many pairs of texts at once, to the last bit.

    The places of each letter in a right text are the bits of a word, so a letter of all left texts is looked up in a few
    array operations. Pairs with a text of more than 64 letters are compared one by one.
    """
    score = np.zeros(len(left))
    if not len(left):
        return score
    at_a, kinds_a = pd.factorize(left)
    at_b, kinds_b = pd.factorize(right)
    short_a, short_b = (np.fromiter((len(t) <= WORD for t in kinds), bool, len(kinds)) for kinds in (kinds_a, kinds_b))
    usable = short_a[at_a] & short_b[at_b]
    equal = left == right
    for i in np.flatnonzero(~usable):
        score[i] = jaro_winkler_pair(left[i], right[i])
    if usable.any():
        texts = [[t if len(t) <= WORD else "" for t in kinds] for kinds in (kinds_a, kinds_b)]
        score[usable] = _in_words(*_letters(texts[0]), at_a[usable], *_letters(texts[1]), at_b[usable])
    return np.where(equal, 1.0, score)


def _in_words(letters_a, lengths_a, at_a, letters_b, lengths_b, at_b) -> np.ndarray:
    one = np.uint64(1)
    known = np.zeros(int(max(letters_a.max(), letters_b.max())) + 1, bool)
    known[letters_a], known[letters_b] = True, True
    number = np.cumsum(known) - 1
    size = int(number[-1]) + 1
    code_a, code_b = number[letters_a], number[letters_b]
    places = np.zeros((len(letters_b), size), np.uint64)
    for j in range(letters_b.shape[1]):
        inside = np.flatnonzero(lengths_b > j)
        places[inside, code_b[inside, j]] |= one << np.uint64(j)
    places, row = places.ravel(), at_b * size
    n_a, n_b = lengths_a[at_a], lengths_b[at_b]
    reach = np.maximum(np.maximum(n_a, n_b) // 2 - 1, 0)
    # Bits i - reach to i + reach: a run of 2 reach + 1 bits (63 at most), moved up or, near the start, cut below.
    run = (one << (2 * reach + 1).astype(np.uint64)) - one
    used = np.zeros(len(at_a), np.uint64)
    hits, seen = [], []
    for i in range(int(n_a.max())):
        shift = i - reach
        window = np.where(shift >= 0, run << np.maximum(shift, 0).astype(np.uint64), run >> np.maximum(-shift, 0).astype(np.uint64))
        of_letter = places[row + code_a[at_a, i]]
        free = np.where(n_a > i, of_letter & window & ~used, np.uint64(0))
        used |= free & (~free + one)
        hits.append(free != 0)
        seen.append(of_letter)
    m = np.zeros(len(at_a), np.int64)
    unlike = np.zeros(len(at_a), np.int64)
    rest = used
    for hit, of_letter in zip(hits, seen):
        first = rest & (~rest + one)
        unlike += hit & ((of_letter & first) == 0)
        rest = np.where(hit, rest ^ first, rest)
        m += hit
    some = np.maximum(m, 1)
    score = (m / np.maximum(n_a, 1) + m / np.maximum(n_b, 1) + (m - unlike // 2) / some) / 3
    prefix, same = np.zeros(len(at_a), np.int64), np.ones(len(at_a), bool)
    for i in range(min(PREFIX_LIMIT, letters_a.shape[1], letters_b.shape[1])):
        same &= (n_a > i) & (n_b > i) & (code_a[at_a, i] == code_b[at_b, i])
        prefix += same
    score = np.where(score > BOOST_FROM, score + prefix * PREFIX_WEIGHT * (1 - score), score)
    return np.where(m == 0, 0.0, score)


def _scored(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have both texts, and the similarity of those."""
    known = (left.notna() & right.notna()).to_numpy()
    return known, jaro_winkler_pairs(left.to_numpy(object)[known], right.to_numpy(object)[known])


@F.pandas_udf(DoubleType())
def _jaro_winkler(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        known, score = _scored(left, right)
        out = np.full(len(known), np.nan)
        out[known] = score
        yield pd.Series(out).astype("Float64").mask(~known)


def jaro_winkler(left: Column, right: Column) -> Column:
    return _jaro_winkler(left, right)


def unequal_level(a: str, b: str) -> int:
    """2 at least 0.92, 1 at least 0.82, 0 below."""
    if not a or not b or cannot_reach(a, b, LIKE):
        return 0
    score = jaro_winkler_pair(a, b)
    return 2 if score >= CLOSE else 1 if score >= LIKE else 0


@F.pandas_udf(IntegerType())
def _levels(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        known, score = _scored(left, right)
        out = np.zeros(len(known), np.int32)
        out[known] = (score >= LIKE).astype(np.int32) + (score >= CLOSE)
        yield pd.Series(out).astype("Int32").mask(~known)


def name_level(left: Column, right: Column) -> Column:
    """3 equal, 2 at least 0.92, 1 at least 0.82, 0 below, -1 unknown.

    Equal and missing names are settled before Python is involved.
    """
    level = _levels(F.when(left != right, left), F.when(left != right, right))
    return (
        F.when(left.isNull() | right.isNull(), -1).when(left == right, 3).otherwise(level)
    )
