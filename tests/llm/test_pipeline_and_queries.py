from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fundtrace.llm import registry

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert [int(n[2:].split("_")[0]) for n in names if n != "pipeline"] == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, docs
    from fundtrace.llm import op2_decontamination as op2
    from fundtrace.llm import op9_ngram_jaccard as op9
    from fundtrace.llm.store import table

    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, table(stage(spark, kept, SF_DIR))
        assert 0 < kept.count() <= before.count(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns, name
            assert kept.join(before, "doc_id", "left_anti").isEmpty()
        if name == "ngram_jaccard_join":
            assert op9.near_duplicates(kept).filter("component_id <> doc_id").isEmpty()
            gone = before.join(kept, "doc_id", "left_anti").select("doc_id")
            found = op9.near_duplicates(before)
            assert found.join(gone, "doc_id").filter("component_id = doc_id").isEmpty()
        if name == "decontamination":
            assert op2.contaminated(kept, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).isEmpty()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(kept.columns)
