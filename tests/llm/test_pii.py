from __future__ import annotations

import hashlib
import random
import re

import pytest

from fundtrace.llm import op1_pii as op

# The base rules as plain regular expressions.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    return sorted((m.start(), n, m.end(), k) for n, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if good(k, m[0]))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def fuzz(seed):
    random.seed(seed)
    parts = ["a@b.co", "x_y@m.org_z@q.io", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0100", "+44.20.7946.0958 ",
             "12 34", "@", "a@b", "é", "🙂", " ", "-", ".", "+", "9", "token.", "\n", "5500000000000004", "+49", "a" * 20]
    return "".join(random.choice(parts) for _ in range(random.randrange(0, 30)))


def test_base_spans_match_plain_regular_expressions(spark):
    texts = [fuzz(k) for k in range(400)] + [None, "", "+1" + " " * 3000, "1" * 3000, "a." * 3000 + "@", "1 " * 8000]
    rows = {r.doc_id: r for r in op.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = base(text)
        assert rows[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in want) for k in PLAIN]


@pytest.fixture(scope="module")
def corpus(spark):
    """One address is always near a nickname, often near a town; common words are everywhere."""
    random.seed(2)
    fill = lambda: " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.choice("abcdefgh")) for _ in range(60))
    rows = []
    for i in range(12):
        rows.append((i, f"{fill()} the Zorro of Tombstone writes as don.diego@vega.org about the sword {fill()}"))
    for i in range(12, 16):
        rows.append((i, f"{fill()} the road to Tombstone {fill()}"))
    for i in range(16, 300):
        rows.append((i, f"{fill()} the of writes as about sword {fill()}"))
    return spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, term string, entity double")


def test_disclosing_terms_add_spans(corpus):
    rows = {r.doc_id: r for r in op.detect(corpus).collect()}
    text = {r.doc_id: r.text for r in corpus.collect()}
    assert all(r.n_email == (i < 12) for i, r in rows.items())
    for i in range(12):
        spans = [tuple(s.rsplit(":", 2)) for s in rows[i].spans.split(",")]
        told = {text[i][int(a) : int(b)] for k, a, b in spans if k == "term"}
        assert "Zorro" in told and "Tombstone" in told and not told & {"the", "of", "writes", "as", "about", "the"}
    assert all(rows[i].spans == "" for i in range(12, 300))


def test_sanitised_texts(corpus):
    got = op.sanitise(corpus)
    assert got.columns == corpus.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    before = {r.doc_id: r.text for r in corpus.collect()}
    for i in range(12):
        assert "[EMAIL]" in texts[i] and "vega" not in texts[i] and "Zorro" not in texts[i] and "Tombstone" not in texts[i]
        # Never without the address: removed; elsewhere too: generalised.
        assert "the  of [TERM] writes" in texts[i]
    assert all(texts[i] == before[i] for i in range(12, 300))


def words_of(text):
    """Terms as {as written}: base spans blanked, punctuation at the edges gone."""
    for a, _, b, _ in base(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return {w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in re.split(r"[\x20\x09-\x0D]+", text)) if w}


def classes_of(kind, value):
    digits = re.sub("[^0-9]", "", value)
    plain = digits if kind in ("card", "phone") else value.lower()
    group = {"email": plain.split("@")[-1], "ip": ".".join(plain.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return {("value", kind, plain), ("group", kind, group), ("kind", kind), ("any",)}


def plain_terms(texts, everywhere):
    """{text: {word: bound}} by counting over sets of texts."""
    texts = {t or "" for t in texts}
    held = {t: set().union(*(classes_of(k, t[a:b]) for a, _, b, k in base(t))) if base(t) else set() for t in texts}
    terms = {t: {w.lower() for w in words_of(t)} for t in texts}
    told: dict = {}
    for c in set().union(*held.values()):
        holding = [t for t in texts if c in held[t]]
        for term in set().union(*(terms[t] for t in holding)):
            n, both = sum(term in terms[t] for t in texts), sum(term in terms[t] for t in holding)
            p, z = both / n, op.BOUND
            sure = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if sure >= op.GENERALISE - 1e-9 and sure * len(texts) / len(holding) >= 2**op.GAIN:
                told[c, term] = sure
    out = {}
    for t in texts:
        out[t] = {w: max((s for (c, term), s in told.items() if term == w.lower() and (everywhere or c in held[t])), default=None) for w in words_of(t)}
    return {t: {w: s for w, s in found.items() if s} for t, found in out.items()}


def mixed(seed, count=150):
    """Texts in which words go with an address, a domain, a kind of number, or with nothing; copies and small changes of some."""
    r = random.Random(seed)
    rows = []
    for i in range(count):
        parts = [r.choice(["alpha", "Beta,", "(gamma)", "delta", "né", f"w{r.randrange(40)}"]) for _ in range(r.randint(3, 25))]
        if i % 5 == 0:
            parts += ["Postbox", f"user{i}@{r.choice(['one.org', 'two.org'])}", r.choice(["Twofold", ""])]
        if i % 7 == 0:
            parts += ["DIAL:", f"+1 202 555 01{i:02d}"]
        if i % 11 == 0:
            parts += ["Boss", "boss@one.org", f"rare{i}"]
        r.shuffle(parts)
        rows.append(" ".join(parts))
    return rows + rows[:20] + [None, "", "Postbox"]


@pytest.mark.parametrize("everywhere", [True, False])
def test_terms_match_plain_counting(spark, everywhere):
    texts = mixed(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_terms(texts, everywhere)
    assert {w.lower() for found in want.values() for w in found} >= {"postbox", "dial", "boss"}
    for r in op.detect(docs, everywhere).collect():
        text = texts[r.doc_id] or ""
        spans = [s.rsplit(":", 2) for s in r.spans.split(",") if s]
        assert {text[int(a) : int(b)] for k, a, b in spans if k == "term"} == set(want[text])
        places = [m.span(1) for m in re.finditer(r"(?:^|(?<=[\x20\x09-\x0D]))[^\w\s]*([^\x20\x09-\x0D]*\w)[^\w\s]*", text) if m[1] in want[text]]
        covered = {i for a, _, b, _ in base(text) for i in range(a, b)}
        assert sorted((int(a), int(b)) for k, a, b in spans if k == "term") == [p for p in places if p[0] not in covered]


def test_a_word_of_one_text_proves_nothing(spark):
    """Neither does one of two near copies; four texts with one kind of entity do, however rare each value is."""
    fill = [(i, f"the quick brown fox number{i % 20} of the river bank writes as a note{i % 50}") for i in range(200)]
    rows = [*fill, (900, "the quick Grimbold of the river bank writes as g@vega.org a note")]
    rows += [(901 + i, f"the Hapax of the river bank{i} writes as h@lyra.org a note") for i in range(2)]
    rows += [(910 + i, f"the quick note{i} Courier of the bank writes as c{i}@mail{i}.net a fox") for i in range(4)]
    got = {r.doc_id: r for r in op.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_term == 0 for i in (900, 901, 902))
    for i, text in rows[-4:]:
        start = text.index("Courier")
        assert got[i].n_term == 1 and f"term:{start}:{start + 7}" in got[i].spans.split(",")


def test_numbering_order_and_copies_move_no_verdict(spark):
    texts = mixed(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    result = lambda df: sorted({tuple(r) for r in op.detect(df, True).collect()})
    want = result(docs)
    assert any(r[-1] for r in want)
    tenfold = docs.crossJoin(spark.range(10)).drop("id")
    for other in (docs.repartition(7), docs.sort("text"), docs.limit(90).unionByName(docs.filter("doc_id >= 90")).unionByName(docs), tenfold):
        assert result(other) == want
    assert op.detect(tenfold).count() == 10 * len(texts)


def test_texts_with_thousands_of_entities(spark):
    import time

    text = " ".join(f"a{i}@b{i % 50}.co" for i in range(12_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    row = op.detect(docs).first()
    assert row.n_email == 12_000 and row.base_sha256 == hashlib.sha256(joined(base(text)).encode()).hexdigest()
    assert op.sanitise(docs).first().text == " ".join(["[EMAIL]"] * 12_000)
    assert time.time() - begun < 60


def test_terms_far_from_the_entity_and_in_other_texts(spark):
    random.seed(3)
    fill = lambda: " ".join(f"{random.choice(['alpha', 'beta', 'gamma'])}{random.choice('abcdefgh')}" for _ in range(60))
    rows = [(i, f'Apollo77 {fill()} ("Zorro"), {fill()} of the zorro. write to don.diego@vega.org {fill()}') for i in range(12)]
    rows += [(12, f"{fill()} Zorro-like, zorro! {fill()}")] + [(i, f"of the {fill()} write to as {fill()}") for i in range(13, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op.detect(docs, everywhere=True).collect()}
    told = lambda i: [rows[i][1][int(a) : int(b)] for k, a, b in (s.rsplit(":", 2) for s in got[i].spans.split(",") if s) if k == "term"]
    assert all(told(i) == ["Apollo77", "Zorro", "zorro"] for i in range(12))
    assert told(12)[-1] == "zorro" and all(got[i].n_term == 0 for i in range(13, 300))
    clean = {r.doc_id: r.text for r in op.sanitise(docs, everywhere=True).collect()}
    assert not any("zorro" in clean[i].lower() for i in range(12)) and "zorro!" not in clean[12]
    assert [t[1] for t in rows[13:]] == [clean[i] for i in range(13, 300)]
    # By default texts without the entity stay.
    assert {r.doc_id for r in op.detect(docs).filter("n_term > 0").collect()} == set(range(12))


def test_awkward_rows(spark, awkward, nothing):
    got = op.detect(awkward).collect()
    assert len(got) == awkward.count() and all(r.spans == "" for r in got)
    kept = op.sanitise(awkward)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, awkward.collect()))
    assert op.detect(nothing).collect() == [] and op.sanitise(nothing).collect() == []


def test_overlapping_spans_are_replaced_once(spark):
    rows = spark.createDataFrame([(1, "call +4111 1111 1111 1111 or a@b.co")], "doc_id long, text string")
    assert op.sanitise(rows).first().text == "call +[CARD] or [EMAIL]" or "1111" not in op.sanitise(rows).first().text


def test_no_python_in_the_plan(corpus):
    plan = op.detect(corpus)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
