"""A training corpus in five stages, each reading what the one before it kept.

``run`` writes every stage's rows as a Parquet table into the shared checkpoint folder and reads them again.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import op1_pii, op2_decontamination, op3_byte_bpe, op7_toxicity_crf, op9_ngram_jaccard
from fundtrace.llm.store import table


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the encoded documents, ids as 4-byte numbers."""
    lines, pattern = op3_byte_bpe.public_ranks(spark)
    both = op3_byte_bpe.decode(op3_byte_bpe.encode(docs, lines, pattern), lines, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", op7_toxicity_crf.stage),
    ("ngram_jaccard_join", op9_ngram_jaccard.stage),
    ("decontamination", op2_decontamination.stage),
    ("pii", op1_pii.stage),
    ("byte_bpe", encode),
]

# Trained models, tilings and encodings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table, without the binary ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs.drop("ids")
