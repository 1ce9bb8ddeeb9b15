"""Quality: a linear-chain CRF labels every line of a document good or bad.

A line's features are shares of character kinds, word lengths, repeats of words and of lines, and the same
numbers of the lines before and after it. Lines inherit their document's label for training. The marginals
of forward-backward, weighted by the lines' lengths, give a document's share of good text; a logistic
function of that share, of its worst stretch and of the amount of text is the score. A document is one chain,
however many lines it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import crf, words
from fundtrace.llm.samples import labelled_sample
from fundtrace.llm.store import documents, fold, prepare

PER_CLASS = 1500  # labelled documents of each class the model is fitted on, at most
BLOCK = 512  # lines of a chain that go one after the other
ROUNDS = 60
_LOWER_CASE = words.separators(bytes(range(ord("a"), ord("z") + 1)) + bytes(range(128, 256)))
_KINDS = [
    _LOWER_CASE,
    words.separators(bytes(range(ord("A"), ord("Z") + 1))),
    words.separators(b"0123456789"),
    words.separators(b"#*$%&<>"),
    words.separators(b"|"),
    words.separators(b"!?"),
    words.separators(b".,;:"),
    words.SPACES,
]


def _share(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[end] - total[begin]


class Lines:
    """Lines with a word, their features and chains."""

    def __init__(self, column: pa.Array):
        found = words.Words(column)
        self.rows = len(found.bounds) - 1
        count = len(found.begin)
        new = np.zeros(count, bool)
        new[found.bounds[:-1][found.bounds[:-1] < count]] = True
        breaks = np.flatnonzero(found.data == 10)
        at = np.searchsorted(breaks, found.begin)
        new[1:] |= at[1:] != at[:-1]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], count] - 1
        begin, end = (found.begin[first], found.end[last]) if count else (np.zeros(0, np.int64),) * 2
        self.row = np.searchsorted(found.bounds, first, "right") - 1
        self.size = (end - begin).astype(np.float64)
        n = len(first)
        features = np.zeros((n, len(_KINDS) + 7), np.float32)
        if n:
            for k, kind in enumerate(_KINDS):
                features[:, k] = _share(kind[found.data], begin, end) / self.size
            amount = (last - first + 1).astype(np.float64)
            features[:, -7] = np.log1p(amount) / 5
            features[:, -6] = self.size / amount / 10
            again = np.r_[False, found.hashes[1:] == found.hashes[:-1]]
            again[first] = False
            features[:, -5] = _share(again, np.r_[first], last + 1) / amount
            features[:, -4] = 1 - self._distinct(found.hashes, np.repeat(np.arange(n), last - first + 1), n) / amount
            key = self._line_hash(found.hashes, first, last)
            features[:, -3] = self._seen_before(key)
            features[:, -2] = found.data[end - 1] == ord(".")
            features[:, -1] = np.minimum(amount, 4) < 4
        same_before = np.r_[False, self.row[1:] == self.row[:-1]] if n else np.zeros(0, bool)
        same_after = np.r_[same_before[1:], False] if n else np.zeros(0, bool)
        before, after = np.zeros_like(features), np.zeros_like(features)
        before[1:][same_before[1:]] = features[:-1][same_before[1:]]
        after[:-1][same_after[:-1]] = features[1:][same_after[:-1]]
        self.features = np.hstack([features, before, after, same_before[:, None], same_after[:, None], np.ones((n, 1))]).astype(np.float32)
        lengths = np.bincount(self.row, minlength=self.rows)
        self.chains = crf.Chains(lengths[lengths > 0], BLOCK)

    @staticmethod
    def _distinct(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((hashes, line))
        h, at = hashes[order], line[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])]
        return np.bincount(at[fresh], minlength=n)

    @staticmethod
    def _line_hash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        place = np.arange(len(hashes)) - np.repeat(first, last - first + 1)
        return words.mix(np.add.reduceat(words.mix(hashes + place.astype(np.uint64) * words._LANES[1]), first))

    def _seen_before(self, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.arange(len(key)), key, self.row))
        k, r = key[order], self.row[order]
        seen = np.r_[False, (k[1:] == k[:-1]) & (r[1:] == r[:-1])]
        out = np.zeros(len(key), bool)
        out[order] = seen
        return out

    def document_features(self, p: np.ndarray) -> np.ndarray:
        """Per row: length-weighted share of good text, its logit, share of clearly bad text, amount of text."""
        total = np.bincount(self.row, self.size, self.rows)
        whole = np.maximum(total, 1)
        good = np.bincount(self.row, self.size * p, self.rows) / whole
        bad = np.bincount(self.row, self.size * (p < 0.5), self.rows) / whole
        return np.column_stack([good, np.log((good + 0.01) / (1.01 - good)), bad, np.minimum(np.log1p(total), 12) / 10, total == 0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Model from at most ``per_class`` labelled documents of each class; a constant one without both classes."""
    sample, totals = labelled_sample(docs, labels, "quality", per_class)
    y = sample["y"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        size = 3 * (len(_KINDS) + 7) + 3
        return {"weights": np.zeros(size, np.float32), "moves": np.zeros((2, 2), np.float32), "document": np.r_[np.zeros(5), np.log((share + 1e-6) / (1 - share + 1e-6))]}
    lines = Lines(pa.array(sample["text"], pa.string()))
    x = lines.features
    scale = np.maximum(x.std(axis=0), 0.05)
    x = x / scale
    weights, moves = crf.train(lambda w: x @ w, lambda d: x.T @ d, x.shape[1], y[lines.row], lines.chains, ROUNDS, 0.3, 1e-4)
    weights = (weights / scale).astype(np.float32)
    found = lines.document_features(crf.marginals(lines.features @ weights, lines.chains, moves))
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    return {"weights": weights, "moves": moves, "document": crf.logistic(found, y, weight)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): how likely the whole text is good.

    Null, empty and wordless texts are scored as texts of no lines. Every row is scored, repeated ones alike;
    other columns are ignored; an empty table gives no rows.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            model = sent.value
            lines = Lines(batch.column(1))
            p = crf.marginals(lines.features @ model["weights"], lines.chains, model["moves"])
            result = crf.sigmoid(lines.document_features(p) @ model["document"][:-1] + model["document"][-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(result)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)
    return score(docs, fit(docs, labels)).select(
        "doc_id", (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
