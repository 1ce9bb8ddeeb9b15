"""Continuous ingest: one streaming query per feed (SRC5, SRC6, SNK3, ST1, ST2, ST8).

A feed is a folder of JSON files. Every micro-batch is validated, resolved and analysed. Its tables go to folders of the
attempt that wrote them, which nobody overwrites; one small file, written last and moved into place in one step,
publishes the attempt. Readers follow these files, so they see a batch whole or not at all, also while another feed
writes or after one failed midway. A published batch that is replayed adds nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fundtrace import schemas
from fundtrace.operators import resolve
from fundtrace.operators.entities import top
from fundtrace.session import checkpoint, scratch
from fundtrace.sources.warehouse import Warehouse, empty, is_absent
from fundtrace.streaming import findings as finding_ops
from fundtrace.streaming import validate

SOURCES = tuple(resolve.FEED_FIELDS)


@dataclass(frozen=True)
class Feed:
    """A source, the folder its files arrive in and the folder results go to."""

    source: str
    inbox: str
    out: str
    max_files: int = 100
    resource_id: str | None = None
    source_url: str | None = None
    # How many of the newest findings tell a new ring from a known one; None takes all.
    prior_findings: int | None = finding_ops.PRIOR_FINDINGS
    # How many of the largest loops are looked at; None takes all.
    loops: int | None = 5000


def read_feed(spark: SparkSession, feed: Feed) -> DataFrame:
    """Lines of a feed as they came. Nothing is parsed or dropped before a batch counts it."""
    return spark.readStream.option("maxFilesPerTrigger", feed.max_files).text(feed.inbox)


def new_rows(lines: DataFrame, feed: Feed, batch: int) -> DataFrame:
    """Rows of a batch whose external id no earlier batch of the feed had; all rows without an id.

    Rows of one batch that share an id all stay, in the order of the files.
    """
    rows = validate.parse_feed(lines.withColumn("_order", F.monotonically_increasing_id()))
    seen = read_table(lines.sparkSession, feed.out, "seen", "external_id string")
    earlier = seen.filter((F.col("feed") == feed.source) & (F.col("batch") < batch))
    return rows.join(earlier.select(F.col("external_id").alias("_id")).distinct(), "_id", "left_anti")


_PUBLISHED = "feed string, batch bigint, attempt string"


def _folder(feed: Feed, table: str, batch: int, attempt: str) -> str:
    return f"{feed.out}/{table}/feed={feed.source}/batch={batch}/attempt={attempt}"


def _published_file(spark: SparkSession, feed: Feed, batch: int, folder: str = "_published"):
    """File system and path of the file that publishes a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{feed.out}/{folder}/{feed.source}-{batch}.json")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_published(spark: SparkSession, feed: Feed, batch: int) -> bool:
    files, path = _published_file(spark, feed, batch)
    return files.exists(path)


def publish(spark: SparkSession, feed: Feed, batch: int, attempt: str) -> None:
    """Make an attempt's folders the batch's result: written beside its place, then renamed."""
    files, path = _published_file(spark, feed, batch)
    _, beside = _published_file(spark, feed, batch, f"_publishing/{attempt}")
    out = files.create(beside, True)
    out.write(json.dumps({"feed": feed.source, "batch": batch, "attempt": attempt}).encode())
    out.close()
    files.mkdirs(path.getParent())
    if not files.rename(beside, path) and not files.exists(path):
        raise OSError(f"cannot publish {path}")


def published(spark: SparkSession, out: str) -> DataFrame:
    """(feed, batch, attempt) of every published batch."""
    try:
        return spark.read.schema(_PUBLISHED).json(f"{out}/_published/")
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return spark.createDataFrame([], _PUBLISHED)


def read_table(spark: SparkSession, out: str, table: str, ddl: str) -> DataFrame:
    """A result table over all feeds and published batches; empty before the first."""
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(f"{out}/{table}")
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return empty(spark, f"{ddl}, feed string, batch bigint")
    keys = ["feed", "batch", "attempt"]
    return rows.join(published(spark, out), keys, "left_semi").select(*[c for c in rows.columns if c != "attempt"])


def prior_ring_ids(spark: SparkSession, feed: Feed, batch: int) -> DataFrame:
    """Rings of the newest findings, this batch's own (from an earlier attempt) left out."""
    earlier = read_table(spark, feed.out, "findings", schemas.FINDING).filter(
        ~((F.col("feed") == feed.source) & (F.col("batch") == batch))
    )
    return top(
        earlier.select("ring_id", "created_at"),
        feed.prior_findings,
        F.desc("created_at"),
        "ring_id",
    )


def process_batch(
    lines: DataFrame,
    batch: int,
    feed: Feed,
    wh: Warehouse,
    index: resolve.MatchIndex,
) -> None:
    """Validate, quarantine, resolve, analyse and store one micro-batch of feed lines (value)."""
    spark = lines.sparkSession
    if is_published(spark, feed, batch):
        return
    batch_id, attempt = f"{feed.source}-{batch}", f"a{uuid.uuid4().hex}"
    provenance = {
        "resource_id": F.lit(feed.resource_id).cast("string"),
        "source_url": F.lit(feed.source_url).cast("string"),
        "fetched_at": F.current_timestamp(),
    }
    with scratch(spark):
        checked = checkpoint(validate.checked(new_rows(lines, feed, batch), feed.source, F.lit(batch_id)))

        def store(df: DataFrame, table: str) -> None:
            df.write.parquet(_folder(feed, table, batch, attempt))

        store(
            validate.quarantine(checked, feed.source).withColumn("created_at", F.current_timestamp()),
            "quarantine",
        )
        store(validate.ledger(checked, feed.source).withColumns(provenance), "ledger")
        store(validate.source_progress(checked, feed.source), "source_progress")
        good = validate.valid_rows(checked)
        resolved = resolve.resolve_rows(good, feed.source, index, "_order")
        found = finding_ops.analyze(
            wh, good, resolved, index, feed.source, prior_ring_ids(spark, feed, batch), order="_order", limit=feed.loops
        )
        store(found.withColumn("created_at", F.current_timestamp()).withColumns(provenance), "findings")
        store(checked.filter("trim(_id) <> ''").select(F.col("_id").alias("external_id")).distinct(), "seen")
        # Last: only then is anything of it read, and do other batches pass its ids over.
        publish(spark, feed, batch, attempt)


def start(
    spark: SparkSession,
    feed: Feed,
    wh: Warehouse,
    checkpoint_dir: str,
    overrides: resolve.Overrides | None = None,
    once: bool = True,
    index: resolve.MatchIndex | None = None,
) -> StreamingQuery:
    """Start the query of one feed: all that is there now (``once``) or continuously."""
    index = index or resolve.build_index(wh, overrides)
    writer = (
        read_feed(spark, feed)
        .writeStream.queryName(f"ingest_{feed.source}")
        .option("checkpointLocation", f"{checkpoint_dir}/{feed.source}")
        .foreachBatch(partial(process_batch, feed=feed, wh=wh, index=index))
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_cycle(
    spark: SparkSession,
    feeds: list[Feed],
    wh: Warehouse,
    checkpoint_dir: str,
    overrides: resolve.Overrides | None = None,
) -> dict[str, str | None]:
    """Run every feed over what has arrived. A feed that fails does not stop the others.

    Returns the error text per source, None where it succeeded.
    """
    outcome: dict[str, str | None] = {}
    with scratch(spark):
        # One index for all feeds, removed with the cycle.
        index = resolve.build_index(wh, overrides)
        for feed in feeds:
            try:
                start(spark, feed, wh, checkpoint_dir, overrides, index=index).awaitTermination()
                outcome[feed.source] = None
            except Exception as error:  # noqa: BLE001 - reported per source
                outcome[feed.source] = str(error)
    return outcome
