"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and the others
as named users; a mask marks what the speaker said, the text a model is trained on. System turns speak
to everyone: they keep their role and have no view of their own. One row is one turn of one view, with
its place in the view's rendered text, so a conversation of any length is never gathered in one task.

    <|assistant|>\\n{text}<|end|>\\n        <|user name=bob|>\\n{text}<|end|>\\n

Turns are numbered in the order of ``turn`` (nulls first), equal ones by role, text and row. Offsets are sums over the
turns before: within blocks of ``BLOCK`` turns first, then over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundtrace.llm.store import prepare, table

SYSTEM = "system"
BLOCK = 1024


def header(role: Column, name: Column) -> Column:
    """What precedes a turn's text: names only distinguish users."""
    return F.when(role == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))


FOOTER = "<|end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with ``place``, 0, 1, ... in each conversation's order, and their ``block``.

    Rows are dealt out by ranges of that order, so a long conversation lies in many partitions; places count within a
    partition first, then the partitions' numbers of turns are added up.
    """
    order = ["conv_id", "turn", "role", "text", "row"]
    rows = turns.withColumn("row", F.monotonically_increasing_id())
    parts = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text", "row")
    parts = parts.withColumn("here", F.row_number().over(here) - 1)
    sizes = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table(sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).select(F.col("conv_id").alias("conv"), F.col("part").alias("of"), "before"))
    parts = parts.join(sizes, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("of")))
    place = (F.col("here") + F.col("before")).cast("long")
    return parts.select("conv_id", "role", "text", place.alias("place"), F.floor(place / BLOCK).alias("block"))


def rotate(turns: DataFrame, system: str = SYSTEM, name=None) -> DataFrame:
    """(conv_id, participant, place, role, name, text, loss, start, end): all views of all conversations.

    ``start`` and ``end`` are the code point offsets of the turn's text in the view's rendering; ``loss`` is true
    where the participant speaks. ``name`` gives a speaker's name from the role, by default the role itself. A null
    role is the speaker ``unknown``; a null text is empty; a null conv_id is a conversation. Repeated rows are
    turns of their own; other columns are ignored. A conversation of system turns only has no view.
    """
    prepare(turns.sparkSession)
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), speaker.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = table(numbered(rows))
    label = name(F.col("role")) if name else F.col("role")
    people = table(rows.filter(F.col("role") != system).select(F.col("conv_id").alias("conv"), F.col("role").alias("participant")).distinct())
    views = rows.withColumn("name", label).join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.col("role") == F.col("participant")
    seen = F.when(F.col("role") == system, F.lit(system)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    views = views.withColumn("loss", own).withColumn("role", seen)
    views = views.withColumn("head", F.length(header(F.col("role"), F.col("name")))).withColumn("size", F.col("head") + F.length("text") + len(FOOTER))
    blocks = views.groupBy("conv_id", "participant", "block").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = table(blocks.select("conv_id", "participant", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base")))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("block").alias("b"), "base")
    within = Window.partitionBy("conv_id", "participant", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("block") == F.col("b"))
    start = F.col("base") + F.col("before") + F.col("head")
    return views.join(blocks, same).select(
        "conv_id", "participant", "place", "role", "name", "text", "loss", start.cast("long").alias("start"), (start + F.length("text")).cast("long").alias("end")
    )


def rendered(turns: DataFrame, per_example: int = BLOCK) -> DataFrame:
    """(conv_id, participant, part, text, masks): training examples of at most ``per_example`` turns of a view.

    A longer view goes on in the next part, so nothing is lost. ``masks`` are the spans [start, end) of the
    participant's own texts within the part.
    """
    views = rotate(turns).withColumn("part", F.floor(F.col("place") / per_example).cast("long"))
    whole = F.concat(header(F.col("role"), F.col("name")), "text", F.lit(FOOTER))
    begin = F.col("start") - F.length(header(F.col("role"), F.col("name")))
    one = F.struct("place", whole.alias("whole"), begin.alias("begin"), "loss", "start", "end")
    parts = views.groupBy("conv_id", "participant", "part").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    base = F.col("turns")[0]["begin"]
    masks = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct((t["start"] - base).alias("start"), (t["end"] - base).alias("end")))
    return parts.select("conv_id", "participant", "part", F.array_join("turns.whole", "").alias("text"), masks.alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'
), v AS (
  SELECT t.conv_id, p.participant, t.place, t.speaker AS name, t.text, t.speaker = p.participant AS loss,
         CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.participant THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, length(CASE WHEN role = 'user' THEN '<|user name=' || name || '|>' ELSE '<|' || role || '|>' END) + 1 AS head FROM v
), s AS (
  SELECT *, coalesce(sum(head + length(text) + 8) OVER (PARTITION BY conv_id, participant ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS start FROM h
)
SELECT conv_id, participant, CAST(place AS BIGINT) AS place, role, name, text, loss, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end" FROM s
"""
