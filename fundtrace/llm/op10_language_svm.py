"""Language identification in two steps: the family first, then one-versus-one within it.

A text is the vector of its hashed byte 2-grams and 3-grams, square roots of their shares. Linear support
vector machines, one for each pair of families, vote for a family; those for each pair of the family's
languages vote for the language, so machines that tell close relatives apart see only these.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundtrace.llm import words
from fundtrace.llm.store import documents, fold, prepare, table

PER_LANGUAGE = 400  # documents of each language the machines are fitted on, at most
BUCKETS = 1 << 12
UNKNOWN = "und"
# Families of ISO 639-1 codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
}


def family_of(language: str, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((name for name, members in families.items() if language in members), language)


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of hashed n-gram shares; digits, symbols and white space count as one space."""
    data, offsets = words.buffers(column)
    rows = len(offsets) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    begin = 0
    while begin < rows:
        # Some rows at a time, so that the working memory stays small.
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + words.BLOCK, "right")) - 1)
        end = min(end, begin + 256)
        for a in range(int(offsets[begin]), int(offsets[end]), 4 * words.BLOCK) if end == begin + 1 else [int(offsets[begin])]:
            b = min(a + 4 * words.BLOCK, int(offsets[end])) if end == begin + 1 else int(offsets[end])
            part = _LETTER[data[a:b]].astype(np.uint32)
            if len(part) < 3:
                continue
            row = np.repeat(np.arange(end - begin), np.diff(np.clip(offsets[begin : end + 1], a, b)))[:-2] * BUCKETS
            two = (part[:-1] * np.uint32(263) + part[1:])
            three = two[:-1] * np.uint32(2654435761) + part[2:] * np.uint32(40503)
            for gram in (two[:-1] * np.uint32(2246822519), three):
                slot = ((gram ^ (gram >> np.uint32(15))) * np.uint32(3266489917) >> np.uint32(20)).astype(np.int64)
                out[begin:end] += np.bincount(row + slot, minlength=(end - begin) * BUCKETS).reshape(-1, BUCKETS)
        begin = end
    total = np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out / total)


_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[: ord("A")] = 32
_LETTER[ord("A") : ord("Z") + 1] += 32
_LETTER[[*range(ord("Z") + 1, ord("a")), *range(ord("z") + 1, 128)]] = 32


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 30, cost: float = 10.0) -> np.ndarray:
    """A linear support vector machine (the last weight is the constant), by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norms = (x * x).sum(axis=1)
    weights, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x), np.float32)
    random = np.random.default_rng(1)
    for _ in range(rounds):
        worst = 0.0
        for i in random.permutation(len(x)):
            slope = y[i] * float(x[i] @ weights) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                weights += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return weights


def _pairs(x: np.ndarray, names: np.ndarray) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    classes = sorted(set(names))
    pairs = list(combinations(range(len(classes)), 2))
    machines = np.zeros((len(pairs), x.shape[1] + 1), np.float32)
    for k, (a, b) in enumerate(pairs):
        own = np.flatnonzero((names == classes[a]) | (names == classes[b]))
        machines[k] = machine(x[own], np.where(names[own] == classes[a], 1.0, -1.0))
    return classes, pairs, machines


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, families: Mapping = FAMILIES) -> dict | None:
    """Machines from at most ``per_language`` documents of each value of ``lang``.

    Documents are chosen by the hash of their ids. None if no language is given.
    """
    prepare(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"))
    # The rank's limit runs before the exchange too, so no task holds all rows of a language.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = table(known.withColumn("place", place).filter(F.col("place") <= per_language).drop("place").distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))

    def scan(batches):
        for batch in batches:
            rows = [v.tobytes() for v in vectors(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "vector"])

    texts = texts.join(chosen, ["doc_id", "lang"]).filter(F.lower("text").rlike(r"\p{L}")).select("lang", F.lower("text"))
    sample = sorted((r["lang"], bytes(r["vector"])) for r in texts.mapInArrow(scan, "lang string, vector binary").collect())
    if not sample:
        return None
    x = np.stack([np.frombuffer(v, np.float32) for _, v in sample])
    langs = np.array([lang for lang, _ in sample])
    of = np.array([family_of(lang, families) for lang in langs])
    return {"family": _pairs(x, of), "within": {f: _pairs(x[of == f], langs[of == f]) for f in sorted(set(of))}}


def _vote(x: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning class by row, and how surely it won: its least margin as a share."""
    classes, pairs, machines = model
    if not pairs:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    margins = x @ machines[:, :-1].T + machines[:, -1]
    votes, sums = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
    least = np.full((len(x), len(classes)), np.inf)
    for k, (a, b) in enumerate(pairs):
        m = margins[:, k]
        votes[:, a] += m >= 0
        votes[:, b] += m < 0
        for c, own in ((a, m), (b, -m)):
            sums[:, c] += np.tanh(own)
            least[:, c] = np.minimum(least[:, c], own)
    best = np.argmax(votes + sums / (2 * len(classes)), axis=1)
    return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(x)), best], -20, 20)))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score): the language of every whole text and how surely it was told, 0 to 1.

    Null texts and texts without a letter are ``und`` with score 0, and so are all if no language was learned. Every row is
    judged, repeated ones alike; other columns are ignored; an empty table gives no rows.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            model, size = sent.value, batch.num_rows
            names, score = np.full(size, UNKNOWN, object), np.zeros(size)
            letters = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False).astype(bool)) if model else np.zeros(0, np.int64)
            if len(letters):
                x = vectors(batch.column(1).take(pa.array(letters)))
                family, sure = _vote(x, model["family"])
                for k, name in enumerate(model["family"][0]):
                    own = np.flatnonzero(family == k)
                    if len(own):
                        best, within = _vote(x[own], model["within"][name])
                        names[letters[own]] = np.array(model["within"][name][0], object)[best]
                        score[letters[own]] = sure[own] * within
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    text = F.lower(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(scan, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5), F.lit(0)) == 0
    model = fit(docs.filter(fold("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
