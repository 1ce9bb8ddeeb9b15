"""What is absent, what is broken, and where intermediate tables go."""

from __future__ import annotations

import types

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from conftest import rows
from fundtrace import session
from fundtrace.sources import sinks
from fundtrace.sources.warehouse import Warehouse


def test_absent_tables_are_empty_and_broken_ones_fail(spark, tmp_path):
    assert Warehouse.from_parquet(spark, str(tmp_path / "nowhere")).entities.count() == 0
    (tmp_path / "entity_golden_records.parquet").write_text("this is no table")
    with pytest.raises((PySparkException, Py4JJavaError)):
        Warehouse.from_parquet(spark, str(tmp_path)).entities.count()
    with pytest.raises((PySparkException, Py4JJavaError)):
        Warehouse.from_parquet(spark, "nosuchscheme://x").entities.count()


def test_a_stored_report_that_is_broken_counts_as_missing(spark, tmp_path):
    broken = tmp_path / "rings.parquet"
    broken.write_text("this is no table")
    for path in (broken, tmp_path / "absent.parquet"):
        assert sinks.load_parquet(spark, str(path), "a int").collect() == []
    with pytest.raises((PySparkException, Py4JJavaError)):
        sinks.load_parquet(spark, "nosuchscheme://x", "a int")
    fallback = spark.createDataFrame([(1,)], "a int")
    assert rows(sinks.load_json_or(spark, str(tmp_path / "absent.json"), "a int", lambda: fallback)) == [(1,)]


@pytest.mark.parametrize("master,allowed", [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_only_one_machine_gets_a_folder_of_its_own(master, allowed):
    made = []
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: made[0] if made else None, setCheckpointDir=made.append)
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default: default))
    if allowed:
        assert session.checkpoint_folder(fake)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_folder(fake)
    fake.conf.get = lambda key, default: "s3a://bucket/shared"
    made.clear()
    assert session.checkpoint_folder(fake) == "s3a://bucket/shared"


def test_scratch_tables_go_at_the_end(spark):
    with session.scratch(spark):
        table = session.checkpoint(spark.range(5))
        (path,) = {f.rpartition("/")[0] for f in table.inputFiles()}
        assert table.count() == 5
    with pytest.raises((PySparkException, Py4JJavaError)):
        spark.read.parquet(path).count()
