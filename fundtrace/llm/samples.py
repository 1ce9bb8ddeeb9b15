"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.llm.store import table


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[pd.DataFrame, dict[int, int]]:
    """Texts of at most ``per_class`` rows of each label (0, 1), chosen by the hash of their ids, and how many rows each label has.

    Rows without an id, text or label take no part; equal texts of one label are taken once. The bound
    holds for the rows, so what reaches the driver does not grow with the corpus.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    totals = {int(r["y"]): int(r["count"]) for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = table(chosen.distinct())  # at most 2 * per_class pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frame = texts.join(F.broadcast(chosen), "doc_id").filter("text is not null").select("doc_id", "text", "y").toPandas()
    frame = frame.sort_values(["doc_id", "text", "y"]).drop_duplicates(["text", "y"]).reset_index(drop=True)
    return frame, totals
