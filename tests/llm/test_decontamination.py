from __future__ import annotations

import random

import numpy as np
import pytest

from fundtrace.llm import op2_decontamination as op

WORDS = [f"word{k}" for k in range(3000)]


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing all positions; the covered words of the item."""
    used_d, used_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while j + k < len(item) and p + k < len(doc) and item[j + k] == doc[p + k] and not used_i[j + k] and not used_d[p + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, j)
        k, p, j = best
        if k < least:
            return covered
        covered += k
        for x in range(k):
            used_d[p + x] = used_i[j + x] = True


@pytest.mark.parametrize("seed", range(30))
def test_tiles_match_plain_tiling(seed):
    random.seed(seed)
    letters = "abcd" if seed % 2 else "abcdefghijkl"
    item = random.choices(letters, k=random.randrange(3, 30))
    doc = random.choices(letters, k=random.randrange(0, 25)) + item[5:14] + random.choices(letters, k=8) + item[:7]
    code = {g: k for k, g in enumerate({tuple(s[k : k + 3]) for s in (doc, item) for k in range(len(s) - 2)})}
    seeds = lambda s: np.array([code[tuple(s[k : k + 3])] for k in range(len(s) - 2)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own, of = seeds(doc), seeds(item)
    hit = np.flatnonzero(np.isin(own, of))
    found = op.tiles(hit, own[hit], of, 3)
    for p, j, k in found:
        assert doc[p : p + k] == item[j : j + k] and k >= 3
    assert len({x for p, _, k in found for x in range(p, p + k)}) == sum(k for _, _, k in found) == len({x for _, j, k in found for x in range(j, j + k)})
    assert [k for *_, k in found] == sorted((k for *_, k in found), reverse=True)
    # Where runs of one length compete, their choice may differ a little from the plain one's.
    assert abs(sum(k for _, _, k in found) - plain_tiles(doc, item, 3)) <= 3


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(4)
    items = [random.choices(WORDS, k=40) for _ in range(6)]
    filler = lambda n: random.choices(WORDS, k=n)
    halves = items[1][20:] + filler(30) + items[1][:20]
    docs = [
        (1, " ".join(filler(50) + items[0] + filler(500))), (2, " ".join(halves)), (3, " ".join(filler(400))), (4, " ".join(items[2][:8] + filler(100))),
        (5, "-- ".join(w.upper() for w in items[3]) + "!"), (6, None), (7, ""), (8, " ".join(items[4] * 200)), (9, " ".join(items[0])), (9, " ".join(items[0])), (None, " ".join(items[0])),
    ]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "two words"), (0, " ".join(items[0])), (None, " ".join(items[5]))]
    make = lambda rows, key: spark.createDataFrame([(*r, "s", 3) for r in rows], f"{key} long, text string, seed string, item int")
    return make(docs, "doc_id"), make(bench, "item_id")


def test_copied_and_reordered_passages_are_found(tables):
    got = sorted((r.doc_id or -1, r.item_id, r.coverage) for r in op.contaminated(*tables).collect())
    assert got == sorted([(1, 0, 1.0)] * 2 + [(2, 1, 1.0), (5, 3, 1.0), (8, 4, 1.0)] + [(9, 0, 1.0)] * 4 + [(-1, 0, 1.0)] * 2)
    assert {r.n_tiles for r in op.contaminated(*tables).filter("doc_id = 2").collect()} == {2}


def test_below_the_threshold(tables):
    (row,) = op.overlaps(*tables).filter("doc_id = 4").collect()
    assert (row.item_id, row.covered_words) == (2, 8)


def test_no_rows(tables):
    docs, items = tables
    assert op.contaminated(docs.limit(0), items).collect() == []
    assert op.contaminated(docs, items.limit(0)).collect() == []


def test_unspaced_scripts_and_short_items(spark):
    items = ["敏捷的棕色狐狸跳过了懒狗", "吾輩は猫である。名前はまだ無い。", "สวัสดีชาวโลกทั้งหลาย", "naïve café «déjà vu»", "forty two", "中"]
    docs = [f"前文，{items[0]}。后文", f"むかし「{items[1]}」と", f"x {items[2]} y", "so NAÏVE… café—déjà–vu!", "it is Forty-Two, forty-three", "two forty", "日本語だけ", "好中好"]
    make = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in op.contaminated(make(docs, "doc_id"), make(items, "item_id")).collect())
    assert got == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0), (7, 5, 1.0)]
