from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from fundtrace.llm import op3_byte_bpe as op

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks(spark):
    return op.public_ranks(spark)


def library(ranks):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks[0])}
    return tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})


def want(encoding, text):
    ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [
    "don't  stop\n\n\nnow <|endoftext|> x" * 40,
    " " * 500 + "a" + "\n" * 300 + "b  c",
    "z" * 900 + " 漢字かな" * 60,
    "🙂👩‍👩‍👧 é\u0301 \u00a0\u2003 tab\t\t 12345678 #### " * 30,
    "short",
    "word " * 300 + "\n \n" + "it's we'll " * 100,
]


def test_long_texts_are_stitched_without_a_trace(spark, ranks):
    encoding = library(ranks)
    got = op.digests(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), *ranks, chunk=64, overlap=24)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {i: want(encoding, t) for i, t in enumerate(TEXTS)}


def test_pieces_join_to_the_text(spark, ranks):
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(TEXTS)], "row long, doc_id long, text string").filter("length(text) > 64")
    pieces = op.long_pieces(rows, ranks[1], 64, 24).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((p.piece, p.text) for p in pieces if p.row == i)
        assert "".join(t for _, t in own) == (text if len(text) > 64 else "")
    # Only runs without a boundary stay joined.
    assert sum(p.row == 0 for p in pieces) > 10


def test_awkward_rows(awkward, ranks):
    encoding = library(ranks)
    got = op.digests(awkward, *ranks).collect()
    expected = [(r.doc_id, *want(encoding, r.text)) for r in awkward.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_no_rows(nothing, ranks):
    assert op.digests(nothing, *ranks).collect() == []
