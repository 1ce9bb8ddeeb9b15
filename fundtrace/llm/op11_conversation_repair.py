"""Conversation structure repair by weighted CYK parsing over intervals of turns.

A repaired dialogue reads ``(s?(ua)+)?`` in the initials of its roles: an optional system turn, then pairs of user and
assistant. The repair grammar is in Chomsky normal form. Its nonterminals [p,q] derive the intervals of turns that
lead from state p of that shape to state q:

    [p,r] -> [p,q] [q,r]
    [p,q] -> a turn kept, given another role or deleted
    [p,q] -> nothing, by inserted turns (the insertion closure of every one-turn cell, on both sides)

A cell holds the least (cost, audit) of each nonterminal, the audit being the initials of the edits. Of two audits of
one interval and one cost none begins with the other (they spend a letter on each turn, and more letters are more
insertions, which cost), so the least of the parts makes the least of the whole. Spans are combined bottom-up by length.

One conversation may be of any length: intervals of ``LEAF`` turns are parsed where they lie, and then ``FAN`` adjacent
intervals at a time, level by level, until one cell spans the conversation. Since a cell holds every pair of states, an
interval's cell does not depend on where it was cut. Turns leave as rows; only the audit is one value a conversation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.op5_chat_perspectives import numbered
from fundtrace.llm.store import prepare, table

LEAF = 32
FAN = 8

# States of the dialogue shape: the initials each takes, and the state they lead to.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
# What may be inserted, and what a turn's role may be changed to.
WRITABLE = "ua"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
FINE, CUT, BLANK, DUPLICATE = "0123"

_CELLS = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
_SPAN = f"conv_id long, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, cells {_CELLS}"


def _better(cell: dict, key: tuple[int, int], cost: int, audit: str) -> None:
    if key not in cell or (cost, audit) < cell[key]:
        cell[key] = (cost, audit)


def _insertions() -> dict[tuple[int, int], tuple[int, str]]:
    """The cell of no turns: the cheapest insertions from each state to each it can reach."""
    cell = {(p, p): (0, "") for p in MOVES}
    for _ in MOVES:
        for (p, q), (cost, audit) in list(cell.items()):
            for initial, r in MOVES[q].items():
                if initial in WRITABLE:
                    _better(cell, (p, r), cost + INSERT, audit + "I")
    return cell


def joined(left: dict, right: dict) -> dict:
    """[p,r] -> [p,q] [q,r]"""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (p, q), (cost, audit) in left.items():
        for r in MOVES:
            other = right.get((q, r))
            if other is None:
                continue
            total, best = cost + other[0], out.get((p, r))
            if best is None or total < best[0] or (total == best[0] and audit + other[1] < best[1]):
                out[p, r] = (total, audit + other[1])
    return out


EMPTY = _insertions()


def turn_cell(initial: str, fault: str) -> dict:
    """The cell of one turn, closed under insertions before and after it."""
    cell = {(p, p): (DELETE, "D") for p in MOVES}
    extra = TRUNCATED if fault == CUT else 0
    if fault in (FINE, CUT):
        for p, taken in MOVES.items():
            for i, q in taken.items():
                if i == initial:
                    _better(cell, (p, q), extra, "K")
                if i in WRITABLE:
                    _better(cell, (p, q), extra + REROLE, "R")
    return joined(joined(EMPTY, cell), EMPTY)


def chart(cells: list[dict]) -> dict:
    """The cell of a whole interval from those of its adjacent parts: every span by length, every split of it."""
    spans = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            best: dict[tuple[int, int], tuple[int, str]] = {}
            for k in range(i + 1, i + length):
                for key, value in joined(spans[i, k], spans[k, i + length]).items():
                    _better(best, key, *value)
            spans[i, i + length] = best
    return spans[0, len(cells)]


def leaf(signature: str) -> tuple:
    """(blank, duplicate, truncated, illegal, first, last, cells) of turns given as initial and fault, two letters each."""
    initials, faults = signature[::2], signature[1::2]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cell = chart([turn_cell(i, f) for i, f in zip(initials, faults)])
    counts = (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal)
    return (*counts, initials[0], initials[-1], rows_of(cell))


def rows_of(cell: dict) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(cell.items())]


def combined(parts: list[dict]) -> tuple:
    """The span of adjacent spans, in order."""
    if len(parts) == 1:
        one = parts[0]
        return tuple(one[k] for k in ("blank", "duplicate", "truncated", "illegal", "first", "last", "cells"))
    between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    cell = chart([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in part["cells"]} for part in parts])
    counts = [sum(part[k] for part in parts) for k in ("blank", "duplicate", "truncated", "illegal")]
    return (*counts[:3], counts[3] + between, parts[0]["first"], parts[-1]["last"], rows_of(cell))


def _spans(groups: DataFrame, work) -> DataFrame:
    """``work`` on the third column of (conv_id, block, parts), once for equal short parts of a batch."""
    schema = _arrow_span()

    def scan(batches):
        for batch in batches:
            done: dict = {}
            found = []
            for parts in batch.column(2).to_pylist():
                if not isinstance(parts, str):
                    found.append(work(parts))
                    continue
                if parts not in done:
                    done[parts] = work(parts)
                found.append(done[parts])
            columns = list(zip(*found)) if found else [[]] * 7
            arrays = [pa.array(list(c), schema.field(i + 2).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=schema)

    return groups.mapInArrow(scan, _SPAN)


def _arrow_span() -> pa.Schema:
    cell = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    counts = [(k, pa.int64()) for k in ("conv_id", "block", "blank", "duplicate", "truncated", "illegal")]
    return pa.schema([*counts, ("first", pa.string()), ("last", pa.string()), ("cells", pa.list_(cell))])


def faulty(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, initial, fault): turns in order, each with its first fault.

    ``place`` counts from 0 in the order of turn (nulls first), role and text. A turn is a duplicate if an earlier one
    has its role and text.
    """
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = table(numbered(rows).drop("block").withColumn("mark", mark))
    firsts = rows.groupBy("conv_id", "mark").agg(F.min("place").alias("seen"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "seen")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    last = F.substring(end, -1, 1)
    fault = F.when(end == "", BLANK).when(F.col("place") > F.col("seen"), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    return rows.select("conv_id", "place", "role", "text", F.when(initial.isin(*ROLES), initial).otherwise("x").alias("initial"), fault.alias("fault"))


def parsed(rows: DataFrame, leaf_size: int = LEAF, fan: int = FAN) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of ``faulty`` turns, one row a conversation."""
    symbol = F.struct("place", F.concat("initial", "fault").alias("symbol"))
    groups = rows.groupBy("conv_id", F.floor(F.col("place") / leaf_size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(symbol)).alias("turns"))
    spans = table(_spans(groups.select("conv_id", "block", F.array_join("turns.symbol", "").alias("parts")), leaf))
    while not spans.filter("block > 0").isEmpty():
        part = F.struct("block", "blank", "duplicate", "truncated", "illegal", "first", "last", "cells")
        groups = spans.groupBy("conv_id", F.floor(F.col("block") / fan).cast("long").alias("up")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
        spans = table(_spans(groups, combined))
    whole = F.filter("cells", lambda c: (c["p"] == 0) & c["q"].isin(*FINAL))
    best = F.array_min(F.transform(whole, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    return spans.select("conv_id", "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def _steps(audits: DataFrame) -> DataFrame:
    """(conv_id, step, place, edit, role) of every edit but deletions; an inserted turn has no place, a kept one no role.

    Turns that stay alternate between user and assistant; an odd number of them begins with a system turn.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string())])

    def scan(batches):
        for batch in batches:
            for conv, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = np.frombuffer(audit.encode(), np.uint8)
                place = np.cumsum(letters != ord("I")) - 1
                steps = np.flatnonzero(letters != ord("D"))
                at = np.arange(len(steps)) - len(steps) % 2
                for begin in range(0, len(steps), 65536):
                    part = steps[begin : begin + 65536]
                    kind = letters[part]
                    written = np.where(at[begin : begin + 65536] % 2 == 0, ROLES["u"], ROLES["a"]).astype(object)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([conv] * len(part), pa.int64()),
                            pa.array(part, pa.int64()),
                            pa.array(place[part], pa.int64(), mask=kind == ord("I")),
                            pa.array([chr(k) for k in kind], pa.string()),
                            pa.array(written, pa.string(), mask=kind == ord("K")),
                        ],
                        schema=schema,
                    )

    return audits.select("conv_id", "audit").mapInArrow(scan, "conv_id long, step long, place long, edit string, role string")


def repair(turns: DataFrame, leaf_size: int = LEAF, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of conversations (conv_id, turn, role, text).

    ``report``: conv_id, blank, duplicate, truncated, illegal, cost, audit. ``repaired``: conv_id, step, edit, role,
    text, the turns that stay in the order of ``step``, kept (K), given a role (R) or inserted (I). A null role or text is
    one space; a null conv_id is a conversation; repeated rows are duplicates of each other; a role whose initial is
    none of s, u and a (an empty one too) fits no place and is changed or deleted. Other columns are ignored; no rows
    give no rows.
    """
    prepare(turns.sparkSession)
    rows = table(faulty(turns))
    report = table(parsed(rows, leaf_size, fan))
    own = rows.select(F.col("conv_id").alias("c"), F.col("place").alias("at"), F.col("role").alias("was"), "text")
    steps = _steps(report)
    back = steps.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("at")), "left")
    return report, back.select("conv_id", "step", "edit", F.coalesce("role", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a turn, 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")], kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def digests(turns: DataFrame) -> DataFrame:
    """The report of damaged conversations with ``gaps`` in their turns and the digest of the repaired text.

    A digest needs a conversation's whole text in one row; ``repair`` itself returns turns.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    hurt = table(damaged(turns))
    report, repaired = repair(hurt)
    line = F.struct("step", F.concat("role", F.lit(":"), "text").alias("line"))
    texts = repaired.groupBy("conv_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line))["line"], "\n"), 256).alias("repaired_sha256"))
    number = F.col("turn").cast("long")
    span = F.max(number) - F.min(number) + 1 - F.count_distinct(number)
    gaps = hurt.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    out = turns.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    for part in (gaps, report, texts):
        out = out.join(part, F.col("conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM base
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) AS copy(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)
), placed AS (
  SELECT conv_id, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt
), r AS (
  SELECT conv_id, place, role, text, initial, CASE WHEN body = '' THEN 'b'
           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
           WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS earlier FROM placed
), moves(p, i, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ins(p, q, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), edits AS (
  SELECT p, p AS q, NULL AS i, 'D' AS letter, 2 AS cost FROM ins WHERE n = 0
  UNION ALL SELECT p, q, i, 'K', 0 FROM moves
  UNION ALL SELECT p, q, NULL, 'R', 1 FROM moves WHERE i <> 's'
), walk AS (
  SELECT conv_id, 0::BIGINT AS place, ins.q AS state, {'c': (5 * n)::BIGINT, 'a': repeat('I', n)} AS best
  FROM (SELECT DISTINCT conv_id FROM r), ins WHERE ins.p = 0
  UNION ALL
  SELECT w.conv_id, r.place, ins.q, min({'c': (w.best.c + e.cost + CASE WHEN r.fault = 't' AND e.letter <> 'D' THEN 5 ELSE 0 END + 5 * n)::BIGINT,
                                         'a': w.best.a || e.letter || repeat('I', n)})
  FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1
  JOIN edits e ON e.p = w.state AND (e.letter = 'D' OR r.fault IN ('', 't')) AND (e.i IS NULL OR e.i = r.initial)
  JOIN ins ON ins.p = e.q
  GROUP BY w.conv_id, r.place, ins.q
), counts AS (
  SELECT conv_id, max(place) AS places, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (place > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
), done AS (
  SELECT w.conv_id, min(w.best) AS best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.places = w.place
  WHERE w.state IN (0, 3) GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS step FROM done WHERE best.a <> ''
), steps AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY step) AS place FROM letters
), stays AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY step) - 1 - count(*) OVER (PARTITION BY conv_id) % 2 AS seat FROM steps WHERE letter <> 'D'
), texts AS (
  SELECT s.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN seat % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
           CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY step)) AS repaired_sha256
  FROM stays s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.place = s.place GROUP BY s.conv_id
), gaps AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM hurt GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN gaps ON gaps.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id
"""
