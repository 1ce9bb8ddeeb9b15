from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from fundtrace.llm import op11_conversation_repair as op

MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def hurt(turns):
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, lines) by walking the turns from left to right."""
    best = {0: (0, "", ())}

    def close(states):
        for _ in range(4):
            for p, (cost, audit, lines) in list(states.items()):
                for i, q in MOVES[p].items():
                    new = (cost + 5, audit + "I", lines + (NAMES.get(i, "") + ":",))
                    if i in "ua" and (q not in states or new < states[q]):
                        states[q] = new
        return states

    if rows:
        close(best)
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        new: dict = {}
        for p, (cost, audit, lines) in best.items():
            options = [(p, (cost + 2, audit + "D", lines))]
            if fault in ("", "t"):
                extra = 5 if fault else 0
                for i, q in MOVES[p].items():
                    if role[:1] == i:
                        options.append((q, (cost + extra, audit + "K", lines + (f"{role}:{text}",))))
                    if i in "ua":
                        options.append((q, (cost + extra + 1, audit + "R", lines + (f"{NAMES[i]}:{text}",))))
            for q, option in options:
                if q not in new or option < new[q]:
                    new[q] = option
        best = close(new)
    return min(best[p] for p in (0, 3) if p in best)


def expected(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = in_order(hurt([t for t in turns if t[0] == conv]))
        numbers = [t for _, t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        found = faults(rows)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = plain(rows)
        out[conv] = (gaps, *map(found.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "conv_id long, turn long, role string, text string, place int, cells string, step int")


@pytest.fixture(scope="module")
def turns():
    random.seed(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unicorn"]
    texts = ["Yes.", "no", "é🙂?", "", None, " \t\n", "Long text! \x0b", "a\nb.", "Yes."]
    rows = [(c, t, random.choice(roles), random.choice(texts)) for c in range(60) for t in range(random.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300) if t % 17]
    rows += [(None, None, "user", "x."), (None, None, "user", "x."), (None, 3, None, None), (101, None, "system", "only."), (102, 5, "user", "w " * 50_000 + ".")]
    return rows


def test_digests_match_a_plain_walk(spark, turns):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[c] for c in columns) for r in op.digests(frame(spark, turns)).collect()}
    assert got == expected(turns)


@pytest.mark.parametrize("leaf, fan", [(1, 2), (7, 3)])
def test_intervals_may_be_cut_anywhere(spark, turns, leaf, fan):
    rows = [t for t in turns if t[0] in (100, 5, 6)]
    whole, cut = (op.repair(frame(spark, rows), *sizes)[0] for sizes in ((op.LEAF, op.FAN), (leaf, fan)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_least_of_all_edits():
    """Against every audit of up to two insertions for short conversations."""
    for kinds in itertools.product(("s0", "u0", "u1", "a0", "x0", "a2"), repeat=3):
        best = None
        for n in range(7):
            for audit in map("".join, itertools.product("KRDI", repeat=n)):
                if len(audit.replace("I", "")) != 3 or audit.count("I") > 3:
                    continue
                for cost in priced(audit, kinds):
                    best = min(best or (cost, audit), (cost, audit))
        cells = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in op.leaf("".join(kinds))[-1]}
        assert min(cells[0, q] for q in op.FINAL if (0, q) in cells) == best


def priced(audit, kinds):
    """Costs at which an audit gives a well-formed dialogue: one or none."""
    states, cost, at = {0}, 0, 0
    for letter in audit:
        if letter == "I":
            cost, states = cost + 5, {q for p in states for i, q in MOVES[p].items() if i in "ua"}
            continue
        initial, fault = kinds[at]
        at += 1
        if letter == "D":
            cost += 2
            continue
        if fault in "23":
            return
        cost += (5 if fault == "1" else 0) + (letter == "R")
        states = {q for p in states for i, q in MOVES[p].items() if (i == initial if letter == "K" else i in "ua")}
    if states & {0, 3}:
        yield cost


def test_repaired_turns_alternate(spark, turns):
    _, repaired = op.repair(frame(spark, turns))
    by_conv: dict = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.step)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows))
        assert all(r.text == "" for r in rows if r.edit == "I")


def test_no_rows(spark, turns):
    report, repaired = op.repair(frame(spark, turns).limit(0))
    assert report.collect() == [] and repaired.collect() == []
    assert op.digests(frame(spark, turns).limit(0)).collect() == []
