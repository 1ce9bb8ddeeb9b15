from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fundtrace.llm import op8_url_filters as op


def to_regex(glob):
    out = re.escape(glob).replace(r"\*\*", "[\\s\\S]*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(out + r"\Z")


globs = st.lists(st.text(alphabet="ab/.*?", min_size=0, max_size=9), min_size=1, max_size=30)
urls = st.lists(st.text(alphabet="ab/.é", max_size=14), max_size=20)


@settings(max_examples=150, deadline=None)
@given(globs, urls)
def test_automaton_matches_regular_expressions(patterns, texts):
    patterns = [re.sub(r"\*{3,}", "**", p) for p in patterns]
    got = op.Automaton(patterns).run(texts)
    want = np.array([[bool(to_regex(p).match(t)) for p in patterns] for t in texts], bool).reshape(len(texts), len(patterns))
    assert (got == want).all()


def test_many_words_of_rules():
    patterns = [f"*.host{i}.org/**" for i in range(40)]
    automaton = op.Automaton(patterns)
    assert automaton.words > 5
    got = automaton.run([".www.host7.org/x", ".host39.org/", ".other.org/", ".a/host7.org/"])
    assert [list(np.flatnonzero(r)) for r in got] == [[7], [39], [], []]


def test_judgements(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://example.net/de"), (3, "https://sub.example.com/de/1"), (4, "http://x.org/fr/"),
        (5, "http://x.org/en/"), (6, "notaurl"), (7, None), (8, "http://a.net"), (9, "http://notexample.net/en/"), (10, "http://m.adult-x.com/en/"),
        (11, "x://h?/p"), (12, ""), (12, ""), (None, "http://a.org/x.net/"), (13, "http://a.org#/fr/"),
    ]
    got = op.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: tuple(r)[1:] for r in got}
    assert by_id[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by_id[2] == ("example.net", "/de", "net/", "block")
    assert by_id[3][2:] == ("example.com/de/", "block")
    assert by_id[4][2:] == ("org/fr/", "allow")
    assert by_id[5][2:] == (None, "allow")
    assert by_id[6] == by_id[7] == by_id[12] == ("", "", None, "allow")
    assert by_id[8] == ("a.net", "", None, "allow")
    assert by_id[9][2:] == ("net/", "block")
    assert by_id[10][2:] == (None, "block")
    assert by_id[11] == ("h", "", None, "allow")
    assert by_id[None] == ("a.org", "/x.net/", None, "allow")
    assert by_id[13] == ("a.org", "", None, "allow")


def test_long_urls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/" + "b" * 20000)], "page_id long, url string")
    assert op.judge(df).first().rule == "net/"
    assert op.judge(df.limit(0)).collect() == []
