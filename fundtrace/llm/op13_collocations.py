"""Phrase collocations, counted as streams that are kept in prefix and in suffix order and merged in lockstep.

Words, pairs and triples are counted one order after the other; a triple is only counted where both its pairs may reach the
threshold, a pair where both its words may (bit maps of bounded size, of which a set bit means "maybe").

The counts that reach the threshold form one stream. In prefix order (a, a b, a b c) an entry comes after the entries of all
its beginnings: one pass over the sorted stream gives every phrase the counts of its first parts, and every pair the
greatest count of a triple that begins with it. Sorted anew in suffix order (c, b c, a b c), a second pass does the same
for last parts. Nothing is looked up: a pass holds two counts and a maximum, whatever the size of a group, and a stream is
dealt out by ranges of its order, so that a frequent word's phrases lie in as many tasks as they need. What a range
begins with may continue the range before it: every range leaves one row with its last counts, and these few rows (one a
range) are applied to the first entries of the next.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundtrace.llm.bits import bit_map, maybe
from fundtrace.llm.store import documents, prepare, table
from fundtrace.llm.words import LOWER, buffers, positions, separators

LEAST = 10
TOP = 2000
# A phrase goes if a longer one that holds it has this share of its count, in percent.
HELD = 50
SCALE = 1_000_000

BREAKS = separators(b".,;:!?\n\x0b\x0c\r")
BETWEEN = separators(b".,;:!?\n\x0b\x0c\r \t")

# A phrase is counted as one string: words hold no space.
_GRAM = "lang string, phrase string, f long"


def _token(*parts) -> F.Column:
    """The token of a word or pair in a bit map, as ``_grams`` computes it."""
    return F.crc32(F.concat("lang", F.lit("\0"), F.concat_ws(" ", *parts)).cast("binary")).alias("token")


def _grams(docs: DataFrame, order: int, bits: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): occurrences of phrases of ``order`` words, joined by spaces, summed per block of text.

    With ``bits`` only phrases whose parts of ``order - 1`` words may be in it. For words a row without ``phrase`` sums all.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches):
        for batch in batches:
            languages = batch.column(0).dictionary_encode()
            names, of_row = languages.dictionary.to_pylist(), languages.indices.to_numpy()
            data, offsets = buffers(batch.column(1))
            held_starts = np.zeros(0, np.int64)
            for _, end, starts, _ in positions(data, offsets, BETWEEN):
                # The last words of the block before may begin a phrase that ends here.
                old, starts = len(held_starts), np.concatenate([held_starts, starts])
                held_starts = starts[-(order - 1) :] if order > 1 else starts[:0]
                if len(starts) > old:
                    yield _block(data, offsets, starts, end, old, names, of_row)

    def _block(data, offsets, starts, end, old, names, of_row):
        raw = data[starts[0] : end]
        at = starts - starts[0]
        letters = ~BETWEEN[raw]
        rows = np.searchsorted(offsets, starts, "right") - 1
        # Words are what stands between separators; a row's end separates too.
        places = np.append(0, np.cumsum(letters))[np.append(at, len(raw))].astype(np.int32)
        text = pa.py_buffer(LOWER[raw[letters]])
        encoded = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(places), text]).dictionary_encode()
        words, number = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        # A word with its language, and the words that this block really has.
        kinds, word = np.unique(of_row[rows].astype(np.int64) * len(words) + number, return_inverse=True)
        language, spelled = kinds // len(words), kinds % len(words)
        if order == 1:
            counts = np.bincount(word[old:], minlength=len(kinds))
            totals = np.bincount(language, counts, len(names)).astype(np.int64)
            there = np.flatnonzero(totals)
            lang = np.concatenate([language, there])
            first = pa.array(np.append(spelled, np.zeros(len(there), np.int64)), mask=np.arange(len(lang)) >= len(kinds))
            return _batch(names, lang, [words.take(first)], np.concatenate([counts, totals[there]]))
        broken = np.cumsum(BREAKS[raw])[at]
        linked = (rows[1:] == rows[:-1]) & (broken[1:] == broken[:-1])
        strings = [w.encode() for w in words.to_pylist()]
        marks = [n.encode() + b"\0" for n in names]
        crc = np.array([zlib.crc32(strings[s], zlib.crc32(marks[g])) for g, s in zip(language.tolist(), spelled.tolist())], np.uint64)
        if order == 2:
            known = maybe(crc, sent.value)[word]
            begin = np.flatnonzero(linked & known[1:] & known[:-1] & (np.arange(1, len(word)) >= old))
            pairs, counts = np.unique(word[begin] * len(kinds) + word[begin + 1], return_counts=True)
            one, two = pairs // len(kinds), pairs % len(kinds)
            return _batch(names, language[one], [words.take(pa.array(spelled[k])) for k in (one, two)], counts)
        begin = np.flatnonzero(linked)
        pairs, pair = np.unique(word[begin] * len(kinds) + word[begin + 1], return_inverse=True)
        one, two = pairs // len(kinds), pairs % len(kinds)
        tokens = np.array([zlib.crc32(b" " + strings[s], c) for s, c in zip(spelled[two].tolist(), crc[one].tolist())], np.uint64)
        of_place = np.full(len(word), -1, np.int64)
        of_place[begin] = np.where(maybe(tokens, sent.value)[pair], pair, -1) if len(pairs) else -1
        begin = np.flatnonzero((of_place[:-2] >= 0) & (of_place[1:-1] >= 0) & (np.arange(2, len(word)) >= old))
        triples, counts = np.unique(of_place[begin] * len(kinds) + word[begin + 2], return_counts=True)
        front, three = triples // len(kinds), triples % len(kinds)
        return _batch(names, language[three], [words.take(pa.array(spelled[k])) for k in (one[front], two[front], three)], counts)

    def _batch(names, lang, columns, counts):
        phrase = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")
        langs = pa.array(names, pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([langs, phrase, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

    return docs.mapInArrow(scan, _GRAM)


def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(totals, counts) of ``docs`` (lang, text): (lang, n) and the stored (lang, a, b, c, f) of all with f >= ``least``."""

    def summed(order: int, bits: np.ndarray | None = None) -> DataFrame:
        sums = _grams(texts, order, bits).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        kept = sums.filter(F.col("phrase").isNull() | (F.col("f") >= least))
        word = [F.col("phrase")] if order == 1 else [F.split("phrase", " ")[i] for i in range(order)]
        word += [F.lit(None).cast("string")] * (3 - order)
        return table(kept.select("lang", *[w.alias(n) for w, n in zip(word, "abc")], "f"))

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = summed(1)
    totals = words.filter("a is null").select("lang", F.col("f").alias("n"))
    found = [words.filter("a is not null")]
    for order, parts in ((2, ["a"]), (3, ["a", "b"])):
        found.append(summed(order, bit_map(found[-1].select(_token(*parts)))))
    return totals, found[0].unionByName(found[1]).unionByName(found[2])


def _merged(stream: DataFrame) -> DataFrame:
    """Phrases of ``stream`` (lang, x, y, z, f, ...) with ``part1``, ``part2`` and ``longer``.

    ``part1`` is the count of the entry x and ``part2`` that of x y (of triples); ``longer`` is the greatest count of
    the triples that go on from a pair, or 0. Other columns stay.
    """
    spark = stream.sparkSession
    # A pair stands before its triples, for its count, and after them, for their greatest count.
    pair = F.col("y").isNotNull() & F.col("z").isNull()
    doubled = stream.withColumn("close", F.explode(F.when(pair, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    order = ["lang", "x", "y", "close", "z"]
    ordered = doubled.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ordered.columns
    at = {n: i for i, n in enumerate(names)}
    added = ["part1", "part2", "longer", "open", "range"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema] + [f"{n} long" for n in added]

    def scan(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        last, most, opened, schema = [-1, -1], 0, False, None
        for batch in batches:
            schema = batch.schema
            f = batch.column(at["f"]).to_numpy()
            closing = batch.column(at["close"]).to_numpy() == 1
            y, z = (batch.column(at[c]).is_valid().to_numpy(zero_copy_only=False) for c in "yz")
            heads = [~y, y & ~z & ~closing]
            parts = []
            for k, head in enumerate(heads):
                place = np.maximum.accumulate(np.where(head, np.arange(len(f)), -1))
                parts.append(np.where(place >= 0, f[place], last[k]))
                last[k] = int(parts[k][-1]) if len(f) else last[k]
            # Triples since the last pair.
            group = np.cumsum(heads[1])
            greatest = np.zeros(int(group[-1]) + 1 if len(f) else 1, np.int64)
            greatest[0] = most
            np.maximum.at(greatest, group[z], f[z])
            begun = (group > 0) | opened
            most, opened = int(greatest[-1]), bool(opened or heads[1].any())
            kept = np.flatnonzero(z | closing)
            columns = [parts[0], parts[1], greatest[group], begun.astype(np.int64), np.full(len(f), number)]
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(c[kept], pa.int64()) for c in columns]], names=[*names, *added])
        # What the next range needs to know: a row without words.
        tail = {"part1": last[0], "part2": last[1], "longer": most, "open": int(opened), "range": number}
        if schema is not None:
            empty = [pa.nulls(1, field.type) for field in schema]
            yield pa.RecordBatch.from_arrays([*empty, *[pa.array([tail[n]], pa.int64()) for n in added]], names=[*names, *added])

    done = table(ordered.mapInArrow(scan, ", ".join(kinds)))
    carried, now = [], [-1, -1, 0]
    for r in sorted(done.filter("x is null").select(*added).collect(), key=lambda r: r["range"]):
        carried.append((r["range"], *now))
        now = [r[p] if r[p] >= 0 else old for p, old in zip(("part1", "part2"), now)] + [r["longer"] if r["open"] else max(now[2], r["longer"])]
    ranges = F.broadcast(spark.createDataFrame(carried, "range long, before1 long, before2 long, most long"))
    known = lambda part, before: F.when(F.col(part) >= 0, F.col(part)).otherwise(F.col(before)).alias(part)
    longer = F.when(F.col("z").isNotNull(), 0).when(F.col("open") == 1, F.col("longer")).otherwise(F.greatest("longer", "most"))
    out = done.filter("x is not null").join(ranges, "range")
    return out.select(*[n for n in names if n != "close"], known("part1", "before1"), known("part2", "before2"), longer.cast("long").alias("longer"))


def phrases(counts: DataFrame) -> DataFrame:
    """(lang, a, b, c, f, l1, l2, r1, r2, longer) of counted pairs and triples.

    ``l1`` and ``l2`` count the first one and two words, ``r1`` and ``r2`` the last ones; ``longer`` is the greatest count of
    a triple that holds a pair.
    """
    prefix = _merged(counts.select("lang", F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"), "f"))
    first = prefix.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"), "f", F.col("part1").alias("l1"), F.col("part2").alias("l2"), F.col("longer").alias("front"))
    words = counts.filter("b is null").select("lang", "a", "b", "c", "f", *[F.lit(None).cast("long").alias(n) for n in ("l1", "l2", "front")])
    both = first.unionByName(words)
    # The last word first; what a pair lacks stays at the end.
    turned = both.select(
        "lang", F.coalesce("c", "b", "a").alias("x"), F.when(F.col("c").isNotNull(), F.col("b")).when(F.col("b").isNotNull(), F.col("a")).alias("y"),
        F.when(F.col("c").isNotNull(), F.col("a")).alias("z"), "f", "a", "b", "c", "l1", "l2", "front",
    )
    return _merged(turned).select("lang", "a", "b", "c", "f", "l1", "l2", F.col("part1").alias("r1"), F.col("part2").alias("r2"), F.greatest("front", "longer").alias("longer"))


def scored(found: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases that no longer one holds: the cut with the least score, the first of equals."""
    wide = "decimal(38,0)"

    def cut(k: int, left: str, right: str) -> F.Column:
        score = F.expr(f"cast({SCALE} as {wide}) * f * f div (cast({left} as {wide}) * {right})")
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    triple = F.col("c").isNotNull()
    best = F.when(triple, F.least(cut(1, "l1", "r2"), cut(2, "l2", "r1"))).otherwise(cut(1, "l1", "r1"))
    kept = found.filter(triple | (100 * F.col("longer").cast(wide) < held * F.col("f").cast(wide)))
    kept = kept.withColumn("best", best)
    return kept.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases (``None``: all).

    A null language is ``und``; null and empty texts have no words; repeated rows count each time. Languages without a
    phrase are not listed; other columns are ignored; an empty table gives no rows. Equal scores go by count, then
    by the phrase's bytes.
    """
    prepare(docs.sparkSession)
    totals, counts = counted(docs, least)
    rows = table(scored(phrases(counts), held))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), g AS (
  SELECT lang, k, CASE WHEN k > 1 THEN words[i + 1] END AS b, words[i] AS a, CASE WHEN k > 2 THEN words[i + 2] END AS c
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), range(1, 4) AS size(k) WHERE i + k - 1 <= len(words)
), f AS (
  SELECT lang, k, a, b, c, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), u AS (SELECT * FROM f WHERE k = 1), p AS (SELECT * FROM f WHERE k = 2), t AS (SELECT * FROM f WHERE k = 3 AND f >= 10
), cuts AS (
  SELECT p.lang, p.a || ' ' || p.b AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r FROM p JOIN u x ON x.lang = p.lang AND x.a = p.a JOIN u y ON y.lang = p.lang AND y.a = p.b
  WHERE p.f >= 10 AND NOT EXISTS (SELECT 1 FROM t WHERE t.lang = p.lang AND t.a = p.a AND t.b = p.b AND 100 * t.f >= 50 * p.f)
    AND NOT EXISTS (SELECT 1 FROM t WHERE t.lang = p.lang AND t.b = p.a AND t.c = p.b AND 100 * t.f >= 50 * p.f)
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 1, x.f, y.f FROM t JOIN u x ON x.lang = t.lang AND x.a = t.a JOIN p y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f FROM t JOIN p x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN u y ON y.lang = t.lang AND y.a = t.c
), s AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
