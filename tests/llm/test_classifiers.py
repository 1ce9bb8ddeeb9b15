from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from fundtrace.llm import crf, op6_quality_crf, op7_toxicity_crf, op10_language_svm


def brute_marginals(scores, moves):
    total, ones = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        p = np.exp(sum(s for s, y in zip(scores, states) if y) + sum(moves[a, b] for a, b in zip(states, states[1:])))
        total += p
        ones += p * np.array(states)
    return ones / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    lengths, moves = [1, 4, 7, 2], rng.normal(size=(2, 2))
    scores = rng.normal(size=sum(lengths)) * 2
    got = crf.marginals(scores, crf.Chains(lengths), moves)
    at = 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute_marginals(scores[at : at + n], moves))
        at += n


def test_training_learns_to_use_neighbours():
    """Each observation is weak, runs of the label are long: the moves have to do the work."""
    rng = np.random.default_rng(1)
    labels = np.repeat(rng.integers(0, 2, 200), 10)
    x = (labels * 2 - 1 + rng.normal(size=len(labels)) * 2)[:, None]
    chains = crf.Chains(np.full(20, 100))
    weights, moves = crf.train(lambda w: x @ w, lambda d: x.T @ d, 1, labels, chains, 80, 0.3, 1e-5)
    assert moves[0, 0] + moves[1, 1] > moves[0, 1] + moves[1, 0]
    chained = ((crf.marginals(x @ weights, chains, moves) > 0.5) == labels).mean()
    alone = ((x[:, 0] > 0) == labels).mean()
    assert chained > alone + 0.1


@pytest.fixture(scope="module")
def toxic(spark):
    random.seed(5)
    rows, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        words = [random.choice("bcdfg") + random.choice("aeiou") + random.choice("lmnrs") + str(random.randrange(9)) for _ in range(random.randrange(20, 90))]
        if bad:
            for _ in range(4):
                words[random.randrange(len(words))] = random.choice(["Vileness", "grotmuck!", "scumwart", "vilething"])
        rows.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:])))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_and_spans(spark, toxic):
    docs, labels = toxic
    model = op7_toxicity_crf.fit(docs, labels.filter("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in op7_toxicity_crf.score(docs, model, spans=True).collect()}
    held = [i for i in got if i % 3 == 1]
    assert np.mean([(got[i].score >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    text = {r.doc_id: r.text for r in docs.collect()}
    found = {text[i][s.start : s.end].lower() for i in held for s in got[i].spans}
    assert found and all(any(w in f for w in ("vile", "grotmuck", "scumwart")) for f in found)
    fresh = spark.createDataFrame([(1, "é 🙂 you scumwart"), (2, "nothing here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in op7_toxicity_crf.score(fresh, model, spans=True).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(8, 16)] and rows[2].spans == []


def test_toxicity_of_awkward_rows(awkward, nothing, toxic):
    model = op7_toxicity_crf.fit(*toxic)
    got = op7_toxicity_crf.score(awkward, model, spans=True).collect()
    assert len(got) == awkward.count() and all(0 <= r.score < 0.7 for r in got)
    assert op7_toxicity_crf.score(nothing, model).collect() == []
    kept = op7_toxicity_crf.keep_below(awkward, model, 0.7)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


@pytest.mark.parametrize("op", [op6_quality_crf, op7_toxicity_crf])
def test_without_labels_scores_are_constant(awkward, toxic, op):
    model = op.fit(toxic[0], toxic[1].limit(0))
    assert len({r.score for r in op.score(awkward, model).collect()}) == 1


@pytest.mark.parametrize("block", [1, 7, 256, 10_000])
def test_long_chains_are_whole(block):
    """Marginals of chains of up to 5,000 places equal the plain recursion over each whole chain."""
    rng = np.random.default_rng(5)
    moves = np.array([[1.5, -1.5], [-1.5, 1.5]]) + rng.normal(size=(2, 2)) * 0.1
    lengths = [5000, 1, 300, 256, 257, 513, 2]
    scores = rng.normal(size=sum(lengths)) * 0.5
    got = crf.marginals(scores, crf.Chains(lengths, block), moves)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = [0, own[0]]
        for t in range(1, n):
            alpha[t] = np.logaddexp(alpha[t - 1, 0] + moves[0], alpha[t - 1, 1] + moves[1]) + [0, own[t]]
            alpha[t] -= alpha[t].max()
        for t in range(n - 2, -1, -1):
            step = beta[t + 1] + [0, own[t + 1]]
            beta[t] = np.logaddexp(moves[:, 0] + step[0], moves[:, 1] + step[1])
            beta[t] -= beta[t].max()
        both = alpha + beta
        assert np.allclose(got[at : at + n], 1 / (1 + np.exp(both[:, 0] - both[:, 1])))
        at += n


def test_long_lines_go_in_blocks(spark):
    import pyarrow as pa

    tokens = op7_toxicity_crf.Tokens(pa.array(["a " * 600 + "\nb c", "", None, "d"]))
    assert sorted(tokens.chains.sizes.tolist(), reverse=True) == [256, 256, 88, 2, 1]
    assert len(tokens.chains.begin) == 3


@pytest.fixture(scope="module")
def quality(spark):
    random.seed(7)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        line = lambda ok: " ".join(random.choice("bcdfg") + random.choice("aeiou") * random.randrange(1, 4) + ("" if ok else random.choice(["###", "$$$", "%%%"])) for _ in range(12)) + "."
        rows.append((i, "\n".join(line(good or random.random() < 0.3) for _ in range(random.randrange(1, 9)))))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(quality):
    docs, labels = quality
    model = op6_quality_crf.fit(docs, labels.filter("doc_id % 5 <> 1"))
    got = {r.doc_id: r.score for r in op6_quality_crf.score(docs, model).collect()}
    held = [i for i in got if i % 5 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.93


def test_quality_of_awkward_rows(awkward, nothing, quality):
    model = op6_quality_crf.fit(*quality)
    got = op6_quality_crf.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert op6_quality_crf.score(nothing, model).collect() == []


def test_line_features_of_repeats():
    import pyarrow as pa

    lines = op6_quality_crf.Lines(pa.array(["same line\nsame line\nother", None, "same line", "x x x"]))
    seen = lines.features[:, len(op6_quality_crf._KINDS) + 7 - 3]
    assert seen.tolist() == [0, 1, 0, 0, 0]
    assert lines.row.tolist() == [0, 0, 0, 2, 3]
    assert lines.features[4, len(op6_quality_crf._KINDS) + 7 - 5] == pytest.approx(2 / 3)


@pytest.fixture(scope="module")
def languages(spark):
    random.seed(9)
    sounds = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "er", "und"], "fr": ["eau", "que", "er", "ent"], "es": ["cion", "que", "ado", "ll"], "xx": ["zq", "xk", "wv"]}
    rows = []
    for i in range(600):
        lang = list(sounds)[i % 5]
        text = " ".join("".join(random.choices(sounds[lang], k=random.randrange(1, 4))) for _ in range(40))
        rows.append((i, text, lang if i % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), [r[1] for r in rows], list(sounds)


def test_languages_of_held_out_documents(languages):
    docs, _, names = languages
    model = op10_language_svm.fit(docs.filter("doc_id % 4 <> 0"))
    assert model["family"][0] == ["germanic", "romance", "xx"]
    got = {r.doc_id: r for r in op10_language_svm.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == names[i % 5] for i in got if i % 4 == 0]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_texts_without_letters_are_undetermined(spark, awkward, nothing, languages):
    model = op10_language_svm.fit(languages[0])
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "🙂"), (5, "漢字"), (6, "the thing")]
    got = {r.doc_id: r.lang_pred for r in op10_language_svm.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i] == "und" for i in (1, 2, 3, 4)) and got[5] != "und" and got[6] == "en"
    assert op10_language_svm.predict(awkward, model).count() == awkward.count()
    assert op10_language_svm.predict(nothing, model).collect() == []
    assert {r.lang_pred for r in op10_language_svm.predict(awkward, None).collect()} == {"und"}


def test_no_language_to_learn(languages):
    assert op10_language_svm.fit(languages[0].filter("lang is null")) is None


def test_every_language_is_learned(spark):
    codes = [f"{a}{b}" for a in "bcdfghjk" for b in "aeiouwxyz"]
    rows = [(10 * n + k, " ".join([f"{c}{c}{c} q{c}"] * (3 + k)), c) for n, c in enumerate(codes) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    families = {"one": tuple(codes[:36]), "two": tuple(codes[36:])}
    model = op10_language_svm.fit(docs, per_language=2, families=families)
    assert len(codes) > 64 and sorted(c for f in model["within"].values() for c in f[0]) == sorted(codes)
    got = {r.doc_id: r.lang_pred for r in op10_language_svm.predict(docs, model).collect()}
    assert got == {i: c for i, _, c in rows}


def test_query_tells_toxic_offsets(spark):
    rows = op7_toxicity_crf.query(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = rows.join(docs, "doc_id").filter("offsets <> ''").collect()
    assert found
    for r in found:
        spans = [tuple(map(int, s.split(":"))) for s in r.offsets.split(",")]
        assert spans == sorted(spans) and all(0 <= a < b <= len(r.text) for a, b in spans)


def test_parts_change_no_score(toxic, awkward, monkeypatch):
    """Scores agree to rounding (sums begin at other rows), spans and decisions exactly."""
    model = op7_toxicity_crf.fit(*toxic)
    docs = toxic[0].select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))

    def scored():
        rows = sorted(op7_toxicity_crf.score(docs, model, True).collect(), key=lambda r: (repr(r.doc_id), repr(r.spans), r.score))
        kept = op7_toxicity_crf.keep_below(toxic[0], model, 0.5).select("doc_id").collect()
        return [(r.doc_id, r.spans) for r in rows], [r.score for r in rows], sorted(r.doc_id for r in kept)

    whole = scored()
    monkeypatch.setattr(op7_toxicity_crf, "PART", 100)
    parts = scored()
    assert parts[0] == whole[0] and parts[2] == whole[2]
    assert np.allclose(parts[1], whole[1], rtol=1e-9, atol=1e-12)
