from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from fundtrace.llm import op13_collocations as op
from fundtrace.llm import words


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top, held=50):
    """All phrases with Python dictionaries."""
    counts: dict = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            found = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        many = {g: v for g, v in f.items() if len(g) > 1 and v >= least}
        longest: dict = defaultdict(int)
        for g, v in many.items():
            if len(g) == 3:
                for pair in (g[:2], g[1:]):
                    longest[pair] = max(longest[pair], v)
        own = []
        for g, v in many.items():
            if 100 * longest.get(g, 0) >= held * v:
                continue
            score, _, left, right = min((1_000_000 * v * v // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            own.append((score, v, " ".join(g), left, right))
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, v, left, right, n, s) for i, (s, v, p, left, right) in enumerate(own[:top])]
    return sorted(out)


def sample(size=300, seed=13):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "in", "New", "york", "city", "é", "É", "漢字", "a\x1fb", "x", "y", "z-1", "\xa0"]
    breaks = [" "] * 9 + ["  ", "\t", ".", ", ", "\n", "\x0b", ";", "! ", "?"]
    rows = []
    for _ in range(size):
        text = "".join(r.choice(vocabulary) + r.choice(breaks) for _ in range(r.randint(0, 40)))
        rows.append((r.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, None), ("en", ""), ("en", " . ,"), ("fr", "new york city " * 30), ("fr", "x " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, "k", 1) for i, r in enumerate(rows)], "lang string, text string, f long, a string, close int")


@pytest.mark.parametrize("least, top", [(10, 2000), (2, 40), (30, 5)])
def test_matches_plain_counting(spark, least, top):
    rows = sample()
    got = sorted(tuple(r) for r in op.collocations(frame(spark, rows), least, top).collect())
    assert got == plain(rows, least, top)
    assert got


@pytest.mark.parametrize("block, partitions", [(16, 7), (200, 40)])
def test_blocks_and_ranges_change_nothing(spark, monkeypatch, block, partitions):
    """Phrases across block ends, and groups that go on from one range to the next, some without any row of their own."""
    monkeypatch.setattr(words, "BLOCK", block)
    rows = sample(120, 5)
    whole = frame(spark, rows).coalesce(1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in op.collocations(whole, 3, None).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == plain(rows, 3, None)


def test_one_block_end_inside_a_phrase(spark, monkeypatch):
    import pyarrow as pa

    text = "one two three four five six seven " * 9
    for block in (8, 13, 40):
        monkeypatch.setattr(words, "BLOCK", block)
        column = pa.array([text, "", "one two", None])
        starts = [s for _, _, s, _ in words.positions(*words.buffers(column), op.BETWEEN)]
        assert len(starts) > 1 and sum(map(len, starts)) == 65


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_007
    counts = [("en", "a", None, None, big), ("en", "b", None, None, big + 2), ("en", "a", "b", None, big - 11)]
    found = op.scored(op.phrases(spark.createDataFrame(counts, "lang string, a string, b string, c string, f long")))
    row = found.collect()[0]
    assert row.score == 1_000_000 * (big - 11) ** 2 // (big * (big + 2))


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert sorted(tuple(r) for r in op.collocations(awkward, 2, 100).collect()) == plain(rows, 2, 100)
    assert op.collocations(nothing).collect() == []


def test_a_phrase_is_counted_as_one_string(spark):
    found = op._grams(spark.createDataFrame([("en", "a b c a b c"), ("de", "x,y z")], "lang string, text string"), 1)
    assert found.columns == ["lang", "phrase", "f"]
    _, counts = op.counted(spark.createDataFrame([("en", "a b c a b c"), ("de", "x,y z")], "lang string, text string"), 2)
    assert sorted((tuple(r) for r in counts.collect()), key=repr) == sorted(
        [("en", "a", None, None, 2), ("en", "b", None, None, 2), ("en", "c", None, None, 2), ("en", "a", "b", None, 2), ("en", "b", "c", None, 2), ("en", "a", "b", "c", 2)], key=repr
    )
