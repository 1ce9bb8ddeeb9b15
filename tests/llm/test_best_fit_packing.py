from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fundtrace.llm import op12_best_fit_packing as op


@pytest.fixture(scope="module")
def vocabulary():
    return op.public_vocabulary()


def plain_pieces(texts, vocabulary, capacity):
    """(row, piece, start, ids) with the library's own encoding of every whole text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    for row, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            yield row, piece, start, ids[start : start + capacity]


def check_places(rows, capacity):
    """Pieces lie in sequences gapless from 0 and within the capacity; returns the number of sequences."""
    by_sequence: dict = {}
    for sequence, offset, length in rows:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def plain_best_fit(lengths, capacity):
    """Number of sequences of best fit by falling length, one piece at a time."""
    room: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(capacity - length)
    return len(room)


def all_places(lengths, plan):
    """Places of all pieces by the plan, ranks given in order."""
    seen, ranks = Counter(), []
    for length in lengths:
        ranks.append(seen[length])
        seen[length] += 1
    sequence, offset = op.place(plan.arrays(), np.array(lengths), np.array(ranks))
    return list(zip(sequence.tolist(), offset.tolist(), lengths))


SHAPES = {
    "mixed": lambda r: [r.randint(1, 100) for _ in range(3000)],
    "thirds": lambda r: [r.randint(30, 52) for _ in range(3000)],
    "halves": lambda r: [r.choice([50, 51, 49, 34, 33, 100]) for _ in range(1000)],
    "one size": lambda r: [34] * 500,
    "tiny": lambda r: [1] * 999 + [100] * 3,
    "few": lambda r: [60, 60, 40, 7],
    "single": lambda r: [100],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("groups, large, bound", [(16, 1 / 4, 1.1), (5, 1 / 8, 1.3), (128, 2 / 5, 1.1)])
def test_plans_are_whole_and_short(shape, groups, large, bound):
    """Five groups of lengths up to 100 are 20 wide, so their rounding costs more."""
    lengths = SHAPES[shape](random.Random(3))
    plan = op.Plan(dict(Counter(lengths)), 100, groups, large)
    assert check_places(all_places(lengths, plan), 100) == plan.sequences
    assert plan.sequences <= bound * plain_best_fit(lengths, 100) + 2


def test_fitting_equals_best_fit_one_by_one():
    for seed in range(20):
        r = random.Random(seed)
        lengths = [r.randint(1, r.choice([5, 30, 60])) for _ in range(400)]
        plan = op.Plan(dict(Counter(lengths)), 60, 1, 1.0)  # nothing is large
        assert plan.sequences == plain_best_fit(lengths, 60)


def test_program_finds_the_best_configurations():
    """Sizes that only fill sequences as 45 + 30 + 25 and 50 + 50."""
    counts = {50: 40, 45: 300, 30: 300, 25: 300}
    lengths = [x for x, n in counts.items() for _ in range(n)]
    plan = op.Plan(counts, 100, 64, 1 / 5)
    assert plan.sequences == 320
    assert check_places(all_places(lengths, plan), 100) == 320


def test_the_grouping_beats_best_fit_where_sizes_are_large():
    r = random.Random(1)
    lengths = [r.randint(1200, 2100) for _ in range(20000)]
    histogram = dict(Counter(lengths))
    assert op.best_plan(histogram, 4096).sequences < 0.985 * op.Plan(histogram, 4096, 1, 1.0).sequences


def test_the_plan_does_not_grow_with_the_corpus():
    r = random.Random(2)
    lengths = [min(4096, int(r.lognormvariate(6.4, 1))) + 1 for _ in range(5000)]
    once = {min(k, 4096): v for k, v in Counter(lengths).items()}
    small, large = op.best_plan(once, 4096, 32), op.best_plan({k: v * 1_000_000 for k, v in once.items()}, 4096, 32)
    assert len(large.ranges) < 3 * len(small.ranges)
    assert large.sequences <= 1.01 * sum(k * v for k, v in once.items()) * 1_000_000 / 4096


def test_ids_are_the_librarys(spark, vocabulary):
    r = random.Random(4)
    bits = ["A", "É", "é", "'s", "'LL", "x", "9", ".", "...", "?", " ", "\n", "　", "\xa0", "\x1c", "̈", "İ", "İ", "Σ", "ß", "漢字", "🙂", "K", "<|endoftext|>", "|", ";", "≠", "don't", "I'M", "can't.", "a.b,c", "1.2"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", " ", "\n\n", "x" * 9000, "hello, World. " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in op.pieces(df, vocabulary, 100, 1, True).collect()}
    want = {}
    for row, piece, start, ids in plain_pieces(texts, vocabulary, 100):
        raw = np.array(ids, "<u4").tobytes()
        want[row, piece] = (start, len(ids), zlib.crc32(raw), raw)
    assert got == want


def test_long_texts_are_cut_in_blocks(spark, vocabulary, monkeypatch):
    from fundtrace.llm import words

    monkeypatch.setattr(words, "BLOCK", 64)
    texts = ["one two, three. " * 500, "", "short", "y" * 700 + " z", None]
    encoder = op.Encoder(vocabulary)
    import pyarrow as pa

    got = [(row, start, ids.tolist()) for row, start, ids in op._cut(pa.array(texts), encoder, 50, 1)]
    assert got == [(row, start, ids) for row, _, start, ids in plain_pieces(texts, vocabulary, 50)]


def test_packing_of_awkward_rows(spark, awkward, nothing, vocabulary):
    rows = op.pack(awkward, vocabulary, 256).collect()
    texts = [r.text for r in awkward.collect()]
    want = Counter(np.array(ids, "<u4").tobytes() for _, _, _, ids in plain_pieces(texts, vocabulary, 256))
    assert Counter(bytes(r.ids) for r in rows) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 256)
    assert op.pack(nothing, vocabulary).collect() == []


def test_sequences_hold_their_pieces(spark, awkward, vocabulary):
    from fundtrace.llm.store import table

    packs = table(op.pack(awkward, vocabulary, 256))
    whole = {r.sequence_id: bytes(r.ids) for r in op.sequences(packs).collect()}
    for r in packs.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in packs.collect())


def test_query(spark, vocabulary):
    folder = "/root/testdata/sf0.001"
    rows = op.query(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    names = list(docs)
    want = {(names[row], piece): (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for row, piece, start, ids in plain_pieces([docs[n] for n in names], vocabulary, 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used = check_places([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert used <= 1.02 * sum(r.length for r in rows) / 4096 + 1
