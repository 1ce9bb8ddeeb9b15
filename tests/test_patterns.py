"""Policy patterns against brute force on a small world, and their plans."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

import fixtures
from conftest import rows
from fundtrace.operators import patterns
from fundtrace.sources.warehouse import Warehouse

DEPARTMENTS = ["d1", "d2", None]
PEOPLE = [("Ann", "Abel"), ("Bob", "Bohr"), ("Cy", "Curie"), (None, None)]


def day(rng):
    return dt.date(rng.randint(2000, 2009), rng.randint(1, 12), rng.randint(1, 28))


def norm(first, last):
    return " ".join(sorted({w for w in f"{first or ''} {last or ''}".lower().split() if len(w) > 1}))


def world(seed):
    rng = random.Random(seed)
    root = {i: f"{i:09d}" for i in range(1, 9)}
    some = lambda: root[rng.randint(1, 8)] + "RR"
    tables = {
        "entity_golden_records": [fixtures.golden(i, f"E{i}", r) for i, r in root.items()],
        "cra_directors": [(some(), fixtures.D, k, *rng.choice(PEOPLE), None) for k in range(20)],
        "cra_qualified_donees": [(some(), day(rng), k, some(), Decimal(rng.randint(1, 90))) for k in range(150)],
        "grants_contributions": [(k, str(k), 0, rng.choice(DEPARTMENTS), Decimal(rng.randint(0, 99)), day(rng), "G") for k in range(80)],
        "lobby_registrations": [(f"r{k}", *rng.choice(PEOPLE), some(), rng.choice(DEPARTMENTS), day(rng)) for k in range(60)],
        "former_offices": [(*rng.choice(PEOPLE), rng.choice(DEPARTMENTS), day(rng)) for _ in range(12)],
        "lobby_contacts": [(f"c{k}", *rng.choice(PEOPLE), some(), rng.choice(DEPARTMENTS), day(rng)) for k in range(120)],
        "department_awards": [(f"a{k % 30}", some(), rng.choice(DEPARTMENTS), day(rng), Decimal(k), rng.choice([None, "one supplier"])) for k in range(60)],
    }
    links = [(f"l{k}", rng.randint(1, 8), "fed", "grants_contributions", f'{{"_id": {k}}}', None, "m", 1.0) for k in range(80)]
    return root, tables, links


def warehouse(spark, tables, links):
    frames = {k: fixtures.frame(spark, k, v) for k, v in tables.items()}
    return Warehouse(spark, {**frames, "entity_source_links": fixtures.frame(spark, "entity_source_links", links)})


def sums(items):
    out: dict = {}
    for key, value in items:
        out[key] = out.get(key, 0) + value
    return out


class Plain:
    """The same patterns by nested loops over the small world."""

    def __init__(self, root, tables, links):
        to = {int(x[0][1:]): root[x[1]] for x in links}
        grants = [g for g in tables["grants_contributions"] if g[4] > 0]
        self.received = sums(((to[g[0]], g[5].year), g[4]) for g in grants)
        self.paid = sums(((to[g[0]], g[3]), g[4]) for g in grants if g[3])
        self.by_department = sums(((to[g[0]], g[5].year, g[3]), g[4]) for g in grants if g[3])
        self.gifts = [(g[0][:9], g[3][:9], g[1].year, g[4]) for g in tables["cra_qualified_donees"] if g[0][:9] != g[3][:9]]
        self.directors = {(d[0][:9], norm(d[3], d[4])) for d in tables["cra_directors"] if norm(d[3], d[4])}
        self.tables = tables

    def given(self, a, b, year):
        return sum(g[3] for g in self.gifts if (g[0], g[1]) == (a, b) and g[2] in (year, year + 1))

    def shared(self, a, b):
        return len({n for r, n in self.directors if r == a} & {n for r, n in self.directors if r == b})

    def conduits(self, share, least):
        numbers = {g[0] for g in self.gifts} | {g[1] for g in self.gifts}
        for (a, year), money in self.received.items():
            for b in numbers - {a}:
                onward, back = self.given(a, b, year), self.given(b, a, year)
                if onward and back and float(onward) >= share * float(money) and self.shared(a, b) >= least:
                    yield a, b, year, float(money), float(onward), float(back), self.shared(a, b)

    def pass_through(self, share, least):
        numbers = {g[0] for g in self.gifts} | {g[1] for g in self.gifts}
        for (a, year), money in self.received.items():
            for b in numbers - {a}:
                first = self.given(a, b, year)
                if not first or float(first) < share * float(money) or self.shared(a, b) < least:
                    continue
                for c in numbers - {a, b}:
                    second = self.given(b, c, year)
                    if second and float(second) >= share * float(money):
                        yield a, b, c, year, float(money), float(first), float(second), min(float(first), float(second)) / float(money), self.shared(a, b)

    def registrations(self):
        for r in self.tables["lobby_registrations"]:
            if norm(r[1], r[2]) and r[4]:
                yield r[0], norm(r[1], r[2]), r[3][:9], r[4], r[5]

    def lobbyists(self):
        seen = sums(((person, client, d), 1) for _, person, client, d, _ in self.registrations())
        for (person, client, d), n in seen.items():
            for charity, name in self.directors:
                if name == person and (client, d) in self.paid and (charity, d) in self.paid:
                    yield person, client, d, charity, n, float(self.paid[client, d]), float(self.paid[charity, d])

    def revolving(self):
        offices = {(norm(o[0], o[1]), o[2], o[3]) for o in self.tables["former_offices"] if norm(o[0], o[1])}
        for rid, person, client, d, filed in self.registrations():
            for who, department, ended in offices:
                if (who, department) == (person, d) and ended < filed <= ended.replace(year=ended.year + 5) and (client, d) in self.paid:
                    yield person, d, ended, rid, client, filed, float(self.paid[client, d])

    def contacts(self, within=None):
        for award, vendor, d, day, amount, reason in self.tables["department_awards"]:
            before = [(c[5], c[0], norm(c[1], c[2])) for c in self.tables["lobby_contacts"] if c[3][:9] == vendor[:9] and c[4] == d and d and c[5] < day]
            if reason and before:
                at, cid, person = max(before)
                if within is None or (day - at).days <= within:
                    yield award, vendor[:9], d, day, amount, cid, person, at, (day - at).days


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_equal_brute_force(spark, seed):
    small = world(seed)
    wh, plain = warehouse(spark, *small[1:]), Plain(*small)
    listed = {
        "conduits": (rows(patterns.conduits(wh, 0.3, 1)), plain.conduits(0.3, 1)),
        "all conduits": (rows(patterns.conduits(wh, 0.1, 0)), plain.conduits(0.1, 0)),
        "pass through": (rows(patterns.pass_through(wh, 0.2)), plain.pass_through(0.2, 1)),
        "lobbyists": (rows(patterns.lobbyist_charities(wh)), plain.lobbyists()),
        "revolving door": (rows(patterns.revolving_door(wh)), plain.revolving()),
        "contacts": (rows(patterns.contact_before_award(wh)), plain.contacts()),
        "late contacts": (rows(patterns.contact_before_award(wh, 90)), plain.contacts(90)),
    }
    for name, (got, want) in listed.items():
        assert got == sorted(want, key=repr), name
        assert got, name
    found = {(r.bn, r.year): (r.departments, r.total) for r in patterns.department_concentration(wh, 2, 20).collect()}
    years = {(b, y) for b, y, _ in plain.by_department}
    each = {k: [v for (b, y, _), v in plain.by_department.items() if (b, y) == k] for k in years}
    assert found == {k: (len(v), float(sum(v))) for k, v in each.items() if len(v) >= 2 and sum(v) > 20}


def test_no_nested_loops(spark):
    small = world(1)
    wh = warehouse(spark, *small[1:])
    for df in (
        patterns.conduits(wh), patterns.pass_through(wh), patterns.department_concentration(wh), patterns.lobbyist_charities(wh),
        patterns.revolving_door(wh), patterns.contact_before_award(wh),
    ):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    wh = Warehouse(spark, {})
    for df in (
        patterns.conduits(wh), patterns.pass_through(wh), patterns.department_concentration(wh), patterns.lobbyist_charities(wh),
        patterns.revolving_door(wh), patterns.contact_before_award(wh),
    ):
        assert df.collect() == []


def test_mutual_gifts_shuffle_the_gifts_once_by_pair(spark):
    rng = random.Random(6)
    bn = lambda: f"{rng.randint(1, 6):09d}RR"
    data = [(bn(), rng.choice([day(rng), None]), k, rng.choice([bn(), bn(), None]), Decimal(rng.randint(0, 9))) for k in range(90)]
    data += data[:20]
    wh = Warehouse(spark, {"cra_qualified_donees": fixtures.frame(spark, "cra_qualified_donees", data)})
    gave = sums(((s[:9], d[:9], date.year - lag), amount) for s, date, _, d, amount in data if date and d and amount > 0 and s != d for lag in (0, 1))
    want = sorted((a, b, y, amount, gave[b, a, y]) for (a, b, y), amount in gave.items() if (b, a, y) in gave)
    found = patterns.mutual_gifts(wh)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows(found) == sorted(want, key=repr) and want
