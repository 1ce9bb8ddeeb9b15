from __future__ import annotations

import random

import pytest

from fundtrace.llm import op5_chat_perspectives as op


def plain(turns):
    """{(conv, participant): (text, [own spans])} one conversation after the other."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or ""))
        for who in {t[2] or "unknown" for t in own} - {"system"}:
            text, spans = "", []
            for _, _, role, said in own:
                role, said = role or "unknown", said or ""
                seen = "system" if role == "system" else "assistant" if role == who else "user"
                text += f"<|user name={role}|>\n" if seen == "user" else f"<|{seen}|>\n"
                if role == who:
                    spans.append((len(text), len(text) + len(said)))
                text += said + "<|end|>\n"
            out[conv, who] = (text, spans)
    return out


@pytest.fixture(scope="module")
def turns():
    random.seed(6)
    rows = [(1, k, random.choice(["ann", "bob", "cy", "system"]), random.choice(["hi", "é🙂", "", None, "longer text"])) for k in range(60)]
    rows += [(2, 0, "system", "only")] + [(None, 1, None, "x"), (None, 2, "ann", "y"), (3, None, "ann", "a"), (3, 1, "bob", "b"), (3, 1, "bob", "b")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 3, 0) for r in rows], "conv_id long, turn long, role string, text string, name string, place int, row int")


def test_views_match_plain_rendering(spark, turns):
    got = op.rotate(frame(spark, turns)).collect()
    want = plain(turns)
    assert {(r.conv_id, r.participant) for r in got} == set(want)
    for key, (text, spans) in want.items():
        own = sorted((r for r in got if (r.conv_id, r.participant) == key), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert [(r.start, r.end) for r in own if r.loss] == spans
        assert all(text[r.start : r.end] == r.text for r in own)
        assert own[-1].end + len(op.FOOTER) == len(text)


def test_blocks_and_parts_change_nothing(spark, turns, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 7)
    got = {(r.conv_id, r.participant): r for r in op.rendered(frame(spark, turns), 10_000).collect()}
    for key, (text, spans) in plain(turns).items():
        assert got[key].text == text and [tuple(m) for m in got[key].masks] == spans


def test_long_views_go_on_in_the_next_part(spark, turns):
    rows = [r for r in op.rendered(frame(spark, turns), 8).collect() if (r.conv_id, r.participant) == (1, "ann")]
    rows.sort(key=lambda r: r.part)
    text, spans = plain(turns)[1, "ann"]
    assert len(rows) == 8 and "".join(r.text for r in rows) == text
    assert sum(len(r.masks) for r in rows) == len(spans)
    assert all(r.text[m.start - 1] == "\n" for r in rows for m in r.masks)


def test_no_rows(spark, turns):
    assert op.rotate(frame(spark, turns).limit(0)).collect() == []
