"""Information-theoretic sanitisation of personal data, with built-in functions only.

Patterns find the protected entities: emails, ip addresses, card and phone numbers. A term can give an entity away too.
Over all distinct texts those are counted that hold a term, and those that hold the term and an entity: of the same
value, of its group (the domain of an address, the first digits of a number), of its kind or of any kind, so a rare
entity is protected by the evidence of its like. ``BOUND`` standard errors below the share of a term's texts that hold the entity is Wilson's
lower bound: what is certain about the term. It leaves -log2(bound) bits of the entity's presence open. Terms that leave
at most a bit (``GENERALISE``) are generalised, those that leave half a bit (``REMOVE``) removed, where they also tell at
least ``GAIN`` bits, the pointwise mutual information, for what most texts hold needs no telling. One joint text proves
nothing (a bound of 0.2), nor do two copies with small changes; four without an exception do. Neither copies of texts
nor the size of the table move a verdict.

Terms are treated wherever in a text they stand and, with ``everywhere``, in texts that do not hold the entity too. The
patterns' own spans stay as they are, disclosing terms add spans of the kind ``term``. A term is a word without the
punctuation at its edges and without regard to case; what a pattern's span covers is no part of a word.

All steps work on distinct texts, known by 128 bits of hash, so results do not hang on how rows are numbered or read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.native import SPACE, folded, joined, let, occurrences
from fundtrace.llm.store import documents, prepare, table

BOUND = 2.0
GENERALISE = 0.5
REMOVE = 0.7
GAIN = 1.0
# Texts with a term and an entity below which no bound reaches GENERALISE: n of n have the bound n / (n + BOUND ^ 2).
EVIDENCE = 4
KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds, each run taken whole from where it begins: a match cannot begin inside a run
# of the same characters unless the match before it ended there (\G), so long runs are read once.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests that a text holds a match at all.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9][\x20().0-9-]"),
}
_SPANS = "array<struct<start:int,end:int,value:string>>"
_SPAN = "struct<start:int,place:int,end:int,kind:string,value:string>"
_FOUND = f"array<{_SPAN}>"
_EDGE = r"[^\p{L}\p{N}\p{M}\x20\x09-\x0D]"
# Runs of these at the beginning or end of a word.
_EDGES = rf"(?<![^\x20\x09-\x0D]){_EDGE}++|(?<!{_EDGE}){_EDGE}++(?![^\x20\x09-\x0D])"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind its spans in the text, as array<struct<start, end, value>>."""

    def spans(kind: str) -> Column:
        found = F.filter(occurrences(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        return F.when(_HINTS[kind](text), found).otherwise(F.array().cast(_SPANS))

    return {kind: spans(kind) for kind in KINDS}


def _ordered(kinds: list[tuple[str, Column]]) -> Column:
    """All spans as array<struct<start, place, end, kind, value>> by start, then kind."""

    def named(place: int, kind: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")),
        )

    return F.sort_array(F.concat(*(named(n, kind, spans) for n, (kind, spans) in enumerate(kinds))))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _classes(kind: Column, value: Column) -> Column:
    """What an entity is one of: its value, its group, its kind and all entities. Spelling of numbers and case do not matter."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    plain = F.when(kind.isin("card", "phone"), digits).otherwise(F.lower(value))
    group = (
        F.when(kind == "email", F.substring_index(plain, "@", -1))
        .when(kind == "ip", F.substring_index(plain, ".", 2))
        .when(kind == "card", F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.lit(4)))
    )
    return F.array(F.xxhash64(F.lit("value"), kind, plain), F.xxhash64(F.lit("group"), kind, group), F.xxhash64(F.lit("kind"), kind), F.xxhash64(F.lit("any")))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hinted(text: Column) -> Column:
    found = F.lit(False)
    for test in _HINTS.values():
        found = found | test(text)
    return found


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of what the spans cover; positions stay."""

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        more = F.array(F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), s["end"] - begin))
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], more).alias("out"))).otherwise(acc)

    built = folded(spans, F.lit(0), "string", step, joined)
    return let(built, lambda all: F.concat(joined(all["out"]), F.substring(text, all["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    """Distinct words of a text outside of its base spans, without punctuation at their edges."""
    plain = F.when(_hinted(text), _blanked(text, _ordered(list(base_spans(text).items())))).otherwise(text)
    return F.array_distinct(F.filter(F.split(F.regexp_replace(plain, _EDGES, ""), SPACE), lambda w: w != ""))


def _key(text: Column) -> list[Column]:
    """128 bits of a text's hash, by which equal texts are one."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


KEY = ["k1", "k2"]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Table (k1, k2, text) of the texts of ``docs``, each once."""
    return table(docs.select(*_key(_text()), _text().alias("text")).dropDuplicates(KEY))


def mentions(texts: DataFrame) -> DataFrame:
    """(k1, k2, class): the classes of the entities in each text."""
    rows = texts.filter(_hinted(F.col("text")))
    rows = rows.select(*KEY, F.explode(_ordered(list(base_spans(F.col("text")).items()))).alias("span"))
    return rows.select(*KEY, F.explode(_classes(F.col("span.kind"), F.col("span.value"))).alias("class")).distinct()


def certain(both: Column, of_term: Column, bound: float = BOUND) -> Column:
    """Wilson's lower bound of the share ``both`` / ``of_term``."""
    n, z = of_term.cast("double"), F.lit(bound)
    p = both / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosures(texts: DataFrame, held: DataFrame, total: int, least: float = GENERALISE, gain: float = GAIN) -> DataFrame:
    """(class, term, disclosed): terms (as hashes) that are certain to ``least`` to stand with an entity of the class.

    ``held`` (k1, k2, class) tells the classes of the ``total`` texts. Only words of texts with an entity are candidates,
    and only classes of ``EVIDENCE`` texts or more; the words of all other texts are merely counted, as hashes.
    """
    of_class = held.groupBy("class").agg(F.count(F.lit(1)).alias("of_class")).filter(F.col("of_class") >= EVIDENCE)
    lists = held.join(of_class, "class").groupBy(*KEY).agg(F.collect_list(F.struct("class", "of_class")).alias("classes"))
    used = texts.join(table(lists), KEY).select("classes", F.explode(_terms(F.col("text"))).alias("term"))
    both = used.select("term", F.explode("classes").alias("c")).groupBy("term", "c.class", "c.of_class").agg(F.count(F.lit(1)).alias("both"))
    both = table(both.filter(F.col("both") >= EVIDENCE))
    terms = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    # A term is certain only where most of its texts hold the class.
    found = both.join(terms.filter(F.col("of_term") >= EVIDENCE), "term").filter(F.col("of_term") <= 2 * F.col("both") / least)
    sure = certain(F.col("both"), F.col("of_term"))
    told = F.log2(sure * F.lit(float(total)) / F.col("of_class"))
    return found.select("class", "term", sure.alias("disclosed"), told.alias("told")).filter((F.col("disclosed") >= least - 1e-9) & (F.col("told") >= gain)).drop("told")


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(_words(F.lower(text)), lambda w: F.xxhash64(w)))


def told_words(texts: DataFrame, everywhere: bool, least: float = GENERALISE) -> DataFrame:
    """(k1, k2, told): per text its disclosing words as they are written, array<struct<word, disclosed>>."""
    held = table(mentions(texts))
    if held.isEmpty():
        return texts.select(*KEY, F.array().cast("array<struct<word:string,disclosed:double>>").alias("told")).limit(0)
    known = table(disclosures(texts, held, texts.count(), least))
    if everywhere:
        best = known.groupBy("term").agg(F.max("disclosed").alias("disclosed"))
        words = texts.select(*KEY, F.explode(_words(F.col("text"))).alias("word"))
        told = words.withColumn("term", F.xxhash64(F.lower("word"))).join(table(best), "term")
    else:
        some = texts.join(held.join(known.select("class").distinct(), "class", "left_semi").select(*KEY).distinct(), KEY)
        words = some.select(*KEY, F.explode(_words(F.col("text"))).alias("word")).withColumn("term", F.xxhash64(F.lower("word")))
        told = words.join(known, "term").join(held, [*KEY, "class"], "left_semi")
    told = told.groupBy(*KEY, "word").agg(F.max("disclosed").alias("disclosed"))
    return told.groupBy(*KEY).agg(F.collect_list(F.struct("word", "disclosed")).alias("told"))


def _term_spans(text: Column, told: Column, remove: float) -> Column:
    """Where the words ``told`` stand in a text, as struct<start, place, end, kind, value>."""
    either = F.array_join(F.transform(told, lambda w: F.regexp_replace(w["word"], r"([^\p{L}\p{N}\p{M}])", r"\\$1")), "|")
    pattern = F.concat(F.lit(rf"(?<![^\x20\x09-\x0D])({_EDGE}*+)("), either, F.lit(rf")(?={_EDGE}*+(?![^\x20\x09-\x0D]))"))
    before, found = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(m: Column) -> Column:
        skips = F.zip_with(F.slice(m["gaps"], 1, F.size(m["found"])), m["before"], lambda g, b: g + F.length(b))
        pairs = F.zip_with(m["found"], skips, lambda w, k: F.struct(w.alias("word"), k.alias("skip")))

        def step(acc: Column, one: Column) -> Column:
            begin = acc["at"] + one["skip"]
            end = begin + F.length(one["word"])
            share = F.element_at(F.filter(told, lambda t: t["word"] == one["word"]), 1)["disclosed"]
            span = F.struct(
                begin.alias("start"), F.lit(len(KINDS)).alias("place"), end.alias("end"), F.lit("term").alias("kind"),
                F.when(share >= remove, F.lit("removed")).otherwise(F.lit("generalised")).alias("value"),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.flatten(folded(pairs, F.lit(0), _SPAN, step)["out"])

    return let(F.struct(before.alias("before"), found.alias("found"), gaps.alias("gaps")), placed)


def found_spans(docs: DataFrame, everywhere: bool = False, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Table (k1, k2, base, terms) of the distinct texts of ``docs`` that have a span.

    ``base`` and ``terms`` are span arrays of struct<start, place, end, kind, value>; for terms ``value`` is
    ``removed`` or ``generalised``. With ``everywhere`` a disclosing term is one in every text, else in those
    that hold the entity.
    """
    texts = distinct_texts(docs)
    told = table(told_words(texts, everywhere, generalise))
    own = texts.filter(_hinted(F.col("text"))).select(*KEY, _ordered(list(base_spans(F.col("text")).items())).alias("base")).filter(F.size("base") > 0)
    rows = texts.join(told.filter(F.size("told") > 0), KEY)
    rows = rows.select(*KEY, "told", F.when(_hinted(F.col("text")), _blanked(F.col("text"), _ordered(list(base_spans(F.col("text")).items())))).otherwise(F.col("text")).alias("plain"))
    terms = rows.select(*KEY, _term_spans(F.col("plain"), F.col("told"), remove).alias("terms"))
    none = F.array().cast(_FOUND)
    found = table(own).join(table(terms), KEY, "full")
    return table(found.select(*KEY, F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms")))


def detect(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null and empty texts have no spans. Repeated rows are rows of their own; other columns are ignored; an empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    found = found_spans(docs, everywhere)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(_text())).join(found, KEY, "left")
    none = F.array().cast(_FOUND)
    rows = rows.select("doc_id", *[F.coalesce(c, none).alias(c) for c in ("base", "terms")])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.sort_array(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, text: str = "text", everywhere: bool = False) -> DataFrame:
    """``docs`` with entities and generalised terms replaced by their kind in brackets and removed terms cut out.

    All other columns stay. Overlapping spans are replaced as one, by the first one's kind. Null stays null.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    found = found_spans(docs.select(F.col(f"`{text}`").alias("text")), everywhere)
    spans = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.sort_array(F.concat("base", "terms")).alias("spans"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("whole"), F.col(f"`{text}`").cast("string").alias("text"))
    whole = whole.select("whole", "text", *_key(_text()))
    rows = whole.join(spans, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["value"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.when(
            s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    pieces = let(folded(F.col("spans"), F.lit(0), "string", step, joined), lambda all: F.concat(joined(all["out"]), F.substring("text", all["at"] + 1, F.length("text"))))
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pieces)
    return rows.select(*(clean.alias(c) if c == text else F.col(f"whole.`{c}`").alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir, "doc_id", "text"), everywhere=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and disclosing terms taken out of their texts."""
    clean = sanitise(docs, everywhere=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
