"""Toxicity: a linear-chain CRF tags the words of toxic spans, its marginals score documents.

Token labels come from document labels: among words and word beginnings, those that are far more frequent in
toxic than in other labelled documents are chosen greedily until toxic documents are covered several times; a
word of a toxic document that has one of them is a toxic token. The CRF learns from these tokens with hashed
features (the word, its first bytes). A chain is a line of words, however long. A document's score is a logistic function of its largest marginal and of the sum of those
over a quarter, so that many harmless words do not add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import crf, words
from fundtrace.llm.samples import labelled_sample
from fundtrace.llm.store import documents, fold, give_back, prepare, trim

PER_CLASS = 1500  # labelled documents of each class the model is fitted on, at most
REJECT = 0.7
PREFIXES = (4, 5, 6, 7, 8)  # bytes
BUCKETS = 1 << 18
PART = 1 << 20  # bytes of text that are scored at once
BLOCK = 256  # words of a chain that go one after the other
ROUNDS = 25
COVER = 4  # chosen features a toxic document should have
ODDS = 20.0  # how much more frequent a chosen feature is in toxic documents
_U = np.uint64


class Tokens:
    """Words of a column with their hashed features and chains."""

    def __init__(self, column: pa.Array):
        found = words.Words(column, words.PUNCTUATION, None, PREFIXES)
        self.begin, self.end, self.bounds, self.offsets = found.begin, found.end, found.bounds, found.offsets
        self.data = found.data
        self.features = [(h >> _U(40)).astype(np.int64) & (BUCKETS - 1) for h in (found.hashes, *found.prefixes)]
        count = len(self.begin)
        new = np.zeros(count + 1, bool)
        new[found.bounds] = True
        new[count] = True
        lines = np.searchsorted(np.flatnonzero(found.data == 10), found.begin)
        new[1:count] |= lines[1:] != lines[:-1]
        starts = np.flatnonzero(new)
        self.chains = crf.Chains(np.diff(starts), BLOCK)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.begin), np.float32)
        for feature in self.features:
            total += weights[feature]
        return total + weights[BUCKETS]

    def pull(self, gradient: np.ndarray) -> np.ndarray:
        total = np.zeros(BUCKETS + 1, np.float32)
        for feature in self.features:
            total[:BUCKETS] += np.bincount(feature, gradient, BUCKETS).astype(np.float32)
        total[BUCKETS] = gradient.sum()
        return total

    def document_features(self, p: np.ndarray) -> np.ndarray:
        """Per row: largest marginal, log of one plus the sum of those over a quarter."""
        out = np.zeros((len(self.bounds) - 1, 2))
        full = np.flatnonzero(np.diff(self.bounds) > 0)
        if len(full):
            out[full, 0] = np.maximum.reduceat(p, self.bounds[full])
            out[full, 1] = np.log1p(np.add.reduceat(np.where(p > 0.25, p, 0), self.bounds[full]))
        return out


def telling_features(tokens: Tokens, labels: np.ndarray) -> list[np.ndarray]:
    """Per feature kind the buckets that tell toxic documents from others."""
    rows = np.repeat(np.arange(len(labels)), np.diff(tokens.bounds))
    toxic_count, other_count = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    least = max(3, int(0.01 * toxic_count))
    candidates = []
    for kind, feature in enumerate(tokens.features):
        pairs = np.unique(rows * BUCKETS + feature)
        row, bucket = pairs // BUCKETS, pairs % BUCKETS
        toxic = labels[row] == 1
        a, b = np.bincount(bucket[toxic], minlength=BUCKETS), np.bincount(bucket[~toxic], minlength=BUCKETS)
        good = (a >= least) & (a / toxic_count >= ODDS * (b + 0.5) / other_count)
        hit = good[bucket] & toxic
        order = np.argsort(bucket[hit], kind="stable")
        own_bucket, own_row = bucket[hit][order], row[hit][order]
        starts = np.flatnonzero(np.r_[True, own_bucket[1:] != own_bucket[:-1]]) if len(own_bucket) else np.zeros(0, int)
        for s, e in zip(starts, np.r_[starts[1:], len(own_bucket)]):
            candidates.append((kind, int(own_bucket[s]), own_row[s:e]))
    demand = np.full(len(labels), COVER)
    chosen: list[set[int]] = [set() for _ in tokens.features]
    while candidates:
        gains = [int((demand[r] > 0).sum()) for _, _, r in candidates]
        best = int(np.argmax(gains))
        if gains[best] < least:
            break
        kind, bucket, own = candidates.pop(best)
        chosen[kind].add(bucket)
        demand[own] -= 1
    return [np.array(sorted(c), np.int64) for c in chosen]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Model from at most ``per_class`` labelled documents of each class; a constant one without both classes."""
    sample, totals = labelled_sample(docs, labels, "toxic", per_class)
    y = sample["y"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        odds = np.log((share + 1e-6) / (1 - share + 1e-6))
        return {"weights": np.zeros(BUCKETS + 1, np.float32), "moves": np.zeros((2, 2), np.float32), "document": np.array([0.0, 0.0, odds])}
    tokens = Tokens(pa.array([t.lower() for t in sample["text"]], pa.string()))
    chosen = telling_features(tokens, y)
    marked = np.zeros(len(tokens.begin), bool)
    for feature, buckets in zip(tokens.features, chosen):
        marked |= np.isin(feature, buckets)
    tags = (marked & (np.repeat(y, np.diff(tokens.bounds)) == 1)).astype(np.int64)
    weights, moves = crf.train(tokens.scores, tokens.pull, BUCKETS + 1, tags, tokens.chains, ROUNDS, 0.5, 1e-7)
    found = tokens.document_features(crf.marginals(tokens.scores(weights), tokens.chains, moves))
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    return {"weights": weights, "moves": moves, "document": crf.logistic(found, y, weight)}


def _parts(column: pa.Array):
    """The column in parts of about ``PART`` bytes, a longer text alone, so memory does not grow with the batch."""
    offsets = words.buffers(column)[1]
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PART, "right")) - 1)
        yield column.slice(begin, end - begin)
        begin = end


def _model(spark: SparkSession, model: dict):
    return spark.sparkContext.broadcast(model)


def score(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """(doc_id, score), with ``spans`` also the toxic spans as code point offsets [start, end).

    Null, empty and wordless texts get the score of a document without toxic words. Every row is scored,
    repeated ones alike; other columns are ignored; an empty table gives no rows.
    """
    sent = _model(prepare(docs.sparkSession), model)

    def scan(batches):
        for batch in batches:
            model, begin = sent.value, 0
            for part in _parts(batch.column(1)):
                tokens = Tokens(part)
                p = crf.marginals(tokens.scores(model["weights"]), tokens.chains, model["moves"])
                found = tokens.document_features(p)
                result = crf.sigmoid(found @ model["document"][:-1] + model["document"][-1])
                columns = [batch.column(0).slice(begin, len(part)), pa.array(result)]
                if spans:
                    columns.append(pa.array(_spans(tokens, p), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                begin += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "spans"][: len(columns)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")))
    return texts.mapInArrow(scan, "doc_id long, score double" + ", spans array<struct<start:long,end:long>>" * spans)


def _spans(tokens: Tokens, p: np.ndarray) -> list[list[dict]]:
    """Runs of neighbouring words that are more likely toxic than not."""
    out: list[list[dict]] = []
    hit = p >= 0.5
    for row in range(len(tokens.bounds) - 1):
        a, b = tokens.bounds[row], tokens.bounds[row + 1]
        own: list[dict] = []
        at = np.flatnonzero(hit[a:b]) + a
        if len(at):
            base = tokens.offsets[row]
            lead = np.cumsum((tokens.data[base : tokens.offsets[row + 1]] & 0xC0) != 0x80)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                start, end = int(tokens.begin[run[0]] - base), int(tokens.end[run[-1]] - base)
                own.append({"start": int(lead[start]) - 1, "end": int(lead[end - 1])})
        out.append(own)
    return out


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels the contract allows to learn from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, training_rows(spark, sf_dir))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return score(docs, model, spans=True).select(
        "doc_id", (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), offsets.alias("offsets")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected as toxic."""
    model = fit(documents(spark, sf_dir, "doc_id", "text"), training_rows(spark, sf_dir))
    give_back()
    return keep_below(docs, model, REJECT)


def keep_below(docs: DataFrame, model: dict, limit: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below ``limit``: filtered in one pass, without a join."""
    sent = _model(prepare(docs.sparkSession), model)

    def part_scores(part: pa.Array) -> np.ndarray:
        model, tokens = sent.value, Tokens(part)
        found = tokens.document_features(crf.marginals(tokens.scores(model["weights"]), tokens.chains, model["moves"]))
        return crf.sigmoid(found @ model["document"][:-1] + model["document"][-1])

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scores = [np.zeros(0)]
        for part in _parts(pa.array(texts, pa.string())):
            scores.append(part_scores(part))
            trim()
        return pd.Series(np.concatenate(scores))

    return docs.filter(scored(F.lower(F.col("text").cast("string"))) < limit)
