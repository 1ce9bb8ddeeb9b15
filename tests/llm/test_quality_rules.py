from __future__ import annotations

import random
import re
from collections import Counter
from math import exp, lgamma, log

import pytest
from pyspark.sql import functions as F

from fundtrace.llm import op4_quality_rules as op


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(w, w[1:], w[2:]))
    often = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len({k + d for k, g in enumerate(grams) if often[g] > 1 for d in range(3)}),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_match_plain_counting(spark):
    random.seed(3)
    texts = [None, "", " ", "a", "a a a", "a a a a", "x y z x y z x y z", "\n\n", "a\na\n a\na"]
    texts += ["".join(random.choice(["a", "b", " ", "\n", "#", " ", "é", "\x0b", "c "]) for _ in range(random.randrange(0, 120))) for _ in range(300)]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain(text), repr(text)


@pytest.mark.parametrize("share,error", [(0.02, 0.01), (0.3, 0.05), (0.005, 0.0001)])
def test_bound_is_the_exact_binomial_one(spark, share, error):
    rows = spark.range(0, 3000, 37).select("id", op.most_rejections(F.col("id"), share, F.lit(error)).alias("k")).collect()
    for r in rows:
        total, k = 0.0, -1
        for i in range(r.id + 1):
            total += exp(lgamma(r.id + 1) - lgamma(i + 1) - lgamma(r.id - i + 1) + i * log(share) + (r.id - i) * log(1 - share))
            if total > error:
                break
            k = i
        assert r.k == (k if r.id else -1), r


@pytest.fixture(scope="module")
def labelled(spark):
    """Two strata; in the second, good documents have many symbols too."""
    random.seed(8)
    rows, labels = [], []
    for i in range(4000):
        stratum, good = ("a", "b")[i % 2], i % 5 > 0
        dirty = not good or (stratum == "b" and random.random() < 0.5)
        words = [f"w{random.randrange(5000)}" + ("###" if dirty else "") for _ in range(60)]
        rows.append((i, " ".join(words), stratum, "s", 1))
        if i % 4:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum string, n_words int")
    return docs, spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def test_cutoffs_hold_per_stratum(labelled):
    docs, labels = labelled
    got = op.judge(docs, labels, false_rejection=0.1).join(docs.select("doc_id", "lang"), "doc_id")
    shares = {(r.lang, r.good): r.kept for r in got.withColumn("good", F.col("doc_id") % 5 > 0).groupBy("lang", "good").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares["a", False] == 0 and shares["a", True] == 1
    assert shares["b", True] == 1


def plain_cutoffs(rows, labels, share, error):
    """{stratum: vector} by testing one vector after the other in Python."""
    good = {i for i, q in labels if i is not None and q == 1}
    held = [r for r in rows if r["doc_id"] in good and not r["base_failed"]]
    strata = {r["lang"] for r in held}
    out = {}
    for stratum in strata:
        own = [r for r in held if r["lang"] == stratum]
        value = {
            "symbols": lambda r: r["n_symbols"] / max(r["word_chars"], 1), "duplicate_lines": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1),
            "repeated_words": lambda r: r["n_repeat_words"] / max(r["n_words"], 1), "long_words": lambda r: r["word_chars"] / max(r["n_words"], 1),
        }
        chosen = None
        for vector in op.sequence_of_cutoffs():
            k = sum(any(value[name](r) > cut for name, cut in vector.items()) for r in own)
            n = len(own)
            at_most_k = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(share) + (n - i) * log(1 - share)) for i in range(k + 1))
            if at_most_k > error / len(strata):
                break
            chosen = vector
        out[stratum] = chosen
    return out


@pytest.mark.parametrize("share, error", [(0.02, 0.05), (0.1, 0.05), (0.4, 0.01)])
def test_cutoffs_match_plain_testing(labelled, share, error):
    docs, labels = labelled
    measured = op.measures(docs, ("lang",)).withColumn("base_failed", op.base_failed())
    found = {r.stratum: r for r in op.cutoffs(measured, labels, "lang", share, error).collect()}
    want = plain_cutoffs([r.asDict() for r in measured.collect()], [(r.doc_id, r.quality) for r in labels.collect()], share, error)
    assert set(found) == set(want) == {"a", "b"}
    for stratum, vector in want.items():
        assert {name: found[stratum][f"cut_{name}"] for name in op._rules()} == (vector or dict.fromkeys(op._rules()))
    assert want["a"] is not None


@pytest.mark.parametrize("count, allowed", [(148, False), (149, True)])
def test_good_labels_that_suffice(spark, count, allowed):
    """One stratum, nothing rejected: 0.98 ^ n must not exceed 0.05."""
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} end{i}", "a") for i in range(count)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    measured = op.measures(docs, ("lang",)).withColumn("base_failed", op.base_failed())
    (row,) = op.cutoffs(measured, labels, "lang").collect()
    assert row.n == count and (row.cut_symbols is not None) == allowed


def test_without_labels_only_the_base_rules_reject(labelled):
    docs, labels = labelled
    got = op.judge(docs, labels.limit(0))
    assert got.filter("kept = base_failed").count() == 0


def test_few_labels_allow_nothing(labelled):
    docs, labels = labelled
    got = op.judge(docs, labels.filter("doc_id < 100"))
    assert got.filter("not kept and not base_failed").count() == 0


def test_awkward_rows(awkward, nothing, labelled):
    got = op.judge(awkward, labelled[1])
    assert got.count() == awkward.count()
    assert {r.doc_id: r.kept for r in got.collect()}[6] is False
    assert op.judge(nothing, labelled[1]).collect() == []


def test_no_python_in_the_plan(labelled):
    assert not re.search("Python|Pandas|Arrow", op.judge(*labelled)._jdf.queryExecution().toString())
