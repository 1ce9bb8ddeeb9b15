from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from fundtrace.llm import op9_ngram_jaccard as op
from fundtrace.llm.components import components


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in (text or "").split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, size=140):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = random.choices(vocabulary, k=60)
    rows, texts = [], []
    for i in range(size):
        kind = random.random()
        if texts and kind < 0.5:
            w = list(random.choice(texts))
            for _ in range(random.randrange(0, 4)):
                if w:
                    w[random.randrange(len(w))] = random.choice(vocabulary)
        elif kind < 0.75:
            w = random.choices(vocabulary, k=random.randrange(0, 15)) + passage + random.choices(vocabulary, k=random.randrange(0, 60))
        else:
            w = random.choices(vocabulary, k=random.choice([0, 1, 2, 4, 5, 6, 9, 30, 120, 300]))
        texts.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,frequent", [(1, 20), (2, 2), (3, 0)])
def test_components_match_brute_force(spark, seed, frequent):
    """Also where most or all tokens are frequent, so that combinations and their fallback decide."""
    rows = corpus(seed)
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_similar_sets_share_a_signature():
    """For random pairs at the threshold, whatever the bit map says."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        pool = rng.integers(0, 2**63, 2 * n + 2, dtype=np.uint64)
        a, lose = pool[:n], int(rng.integers(0, n // 5 + 1))
        b = np.r_[a[lose:], pool[n : n + int(rng.integers(0, n // 5 + 1))]]
        common = n - lose
        if not len(b) or 100 * common < 80 * (n + len(b) - common):
            continue
        bits = np.zeros(1 << 10, np.int64)
        share = rng.random()
        for t in pool[rng.random(len(pool)) < share]:
            slot = int(t) & (len(bits) * 64 - 1)
            bits[slot >> 6] |= np.int64(np.uint64(1 << (slot & 63)).view(np.int64))
        x = op.signatures(np.sort(a), len(a), True, bits, groups=16)
        y = op.signatures(np.sort(b), len(b), True, bits, groups=16)
        shared = set(x[0].tolist()) & set(y[0].tolist()) | set(x[1].tolist()) & set(y[1].tolist())
        assert shared, (n, lose, len(b), share)


def test_awkward_rows(spark, awkward):
    got = op.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_shingles == by_id[3].n_shingles == by_id[4].n_shingles == 0
    assert by_id[3].component_id == 3
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert by_id[7].n_shingles == by_id[6].n_shingles == by_id[8].n_shingles == 1


def test_no_rows(nothing):
    assert op.near_duplicates(nothing).collect() == []


def test_stage_keeps_one_of_each_group(spark, awkward):
    kept = op.stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted((i is None, i or 0) for i in [1, 2, 3, 4, None, 5, 6, 7, 8])


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (7, 300), (300, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, 300, *range(200, 260)]}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_copies_make_a_linear_number_of_candidates(spark, monkeypatch):
    """One group of 300 near copies, all of whose tokens are frequent, is linked without all its pairs."""
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[(7 * i) % 200] = f"x{i}"
        rows.append((i, " ".join(w)))
    seen = []
    real = op._verified
    monkeypatch.setattr(op, "_verified", lambda docs, nodes, pairs, shingle: seen.append(pairs.count()) or real(docs, nodes, pairs, shingle))
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(seen) < 3000
