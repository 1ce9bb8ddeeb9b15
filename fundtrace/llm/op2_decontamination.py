"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item become candidates when they share a seed, a run of ``TILE`` words: seeds of
the documents are looked up in a bit map of the benchmark's, the few that remain join the benchmark's seeds.
For each candidate the longest common run of words is marked again and again, running Karp-Rabin over what is
not marked yet, until no run of ``TILE`` words is left. Tiles may stand in any order, so a passage whose
sentences were moved is found as well. The share of the item's words that tiles cover decides.

Words are runs of letters and digits, without regard to case, so punctuation and line breaks do not matter. In
scripts that write no spaces between words, each character is a word. An item of fewer than ``TILE`` words has one
seed, all of its words, and is found where these stand in a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm import words
from fundtrace.llm.bits import bit_map, maybe
from fundtrace.llm.store import documents, prepare, table

TILE = 5
COVERAGE = 0.5
# Characters that are words: scripts without spaces, and the Japanese signs that belong to several of them.
_UNSPACED = r"[\u0E00-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsJavanese}\p{IsBalinese}\u30FC\uFF70]]"
_U = np.uint64
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def plain(text: Column) -> Column:
    """Lower case, with a space for what is no letter, mark or digit beyond ASCII and around characters that are words."""
    low = F.lower(text.cast("string"))
    spaced = F.regexp_replace(F.regexp_replace(low, r"[\x80-\x{10FFFF}&&[^\p{L}\p{M}\p{N}]]+", " "), _UNSPACED, " $0 ")
    return F.when(low.rlike(r"[^\x00-\x7F]"), spaced).otherwise(low)


def benchmark_seeds(items: DataFrame, tile: int = TILE) -> DataFrame:
    """(item, item_id, size, seeds): per item its words' number and the hashes of all runs of ``tile`` words, or of all its words if they are fewer."""

    def scan(batches):
        for batch in batches:
            found = words.Words(batch.column(2), words.PUNCTUATION, None)
            grams, _ = found.windows(tile)
            short = {size: found.windows(size)[0] for size in range(1, tile)}
            seeds = [
                (short[b - a][a : a + 1] if 0 < b - a < tile else grams[a : max(a, b - tile + 1)]).view(np.int64)
                for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(found.bounds)), pa.array(seeds, pa.list_(pa.int64()))],
                names=["item", "item_id", "size", "seeds"],
            )

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), plain(F.col("text")))
    return rows.mapInArrow(scan, "item long, item_id long, size long, seeds array<long>")


def document_seeds(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(row, doc_id, at, seed): the documents' seeds of these sizes that may be the benchmark's, with their word position."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches):
        for batch in batches:
            found = words.Words(batch.column(2), words.PUNCTUATION, None)
            runs = [found.windows(size) for size in sizes]
            hits = [np.flatnonzero(inside & maybe(grams, sent.value)) for grams, inside in runs]
            seed, hit = np.concatenate([grams[h] for (grams, _), h in zip(runs, hits)]), np.concatenate(hits)
            of = np.searchsorted(found.bounds, hit, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(hit - found.bounds[of]), pa.array(seed.view(np.int64))],
                names=["row", "doc_id", "at", "seed"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), plain(F.col("text")))
    return rows.mapInArrow(scan, "row long, doc_id long, at long, seed long")


def _sums(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for rolling hashes of runs of seeds, and the powers that align them."""
    up, down = np.full(len(seeds) + 1, _STEP, _U), np.full(len(seeds) + 1, _BACK, _U)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    total = np.zeros(len(seeds) + 1, _U)
    np.cumsum(seeds * up[:-1], dtype=_U, out=total[1:])
    return total, down


def tiles(at: np.ndarray, doc: np.ndarray, item: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Tiles (word in the document, word in the item, length), longest first.

    ``at`` are word positions of the document's seeds ``doc``, ascending; ``item`` all seeds of the item in order.
    """
    if not len(at) or not len(item):
        return []
    base = at - at[0]
    free_doc, free_item = np.ones(int(base[-1]) + tile, bool), np.ones(len(item) + tile - 1, bool)
    doc_sum, doc_down = _sums(doc)
    item_sum, item_down = _sums(item)
    breaks = np.flatnonzero(np.diff(base) != 1)
    longest = int(np.diff(np.r_[-1, breaks, len(base) - 1]).max())
    out: list[tuple[int, int, int]] = []
    for run in range(min(longest, len(item)), 0, -1):
        size = run + tile - 1
        first = np.arange(len(base) - run + 1)
        first = first[base[first + run - 1] - base[first] == run - 1]
        own = np.arange(len(item) - run + 1)
        # Runs of words that no tile has taken.
        used_doc, used_item = np.r_[0, np.cumsum(~free_doc)], np.r_[0, np.cumsum(~free_item)]
        first = first[used_doc[base[first] + size] == used_doc[base[first]]]
        own = own[used_item[own + size] == used_item[own]]
        doc_hash = (doc_sum[first + run] - doc_sum[first]) * doc_down[first]
        item_hash = (item_sum[own + run] - item_sum[own]) * item_down[own]
        common = np.isin(item_hash, doc_hash)
        if not common.any():
            continue
        places: dict[int, list[int]] = {}
        keep = np.isin(doc_hash, item_hash[common])
        for h, p in zip(doc_hash[keep].tolist(), base[first[keep]].tolist()):
            places.setdefault(h, []).append(p)
        for queue in places.values():
            queue.reverse()
        for h, j in zip(item_hash[common].tolist(), own[common].tolist()):
            if not free_item[j : j + size].all():
                continue
            queue = places[h]
            while queue:
                p = queue.pop()
                if free_doc[p : p + size].all():
                    free_doc[p : p + size] = False
                    free_item[j : j + size] = False
                    out.append((p + int(at[0]), j, size))
                    break
    return out


def overlaps(docs: DataFrame, items: DataFrame, tile: int = TILE) -> DataFrame:
    """(row, doc_id, item_id, item_words, n_tiles, covered_words): every document row and item that share a seed.

    Null and empty texts share none. Repeated rows and items are
    compared each; other columns are ignored; an empty table on either side gives no rows.
    """
    prepare(docs.sparkSession)
    bench = table(benchmark_seeds(items, tile))
    seeds = table(bench.select("item", F.explode("seeds").alias("seed")).distinct())
    bits = bit_map(seeds.select(F.col("seed").alias("token")))
    short = bench.filter(F.col("size").between(1, tile - 1)).select("size").distinct().collect()  # fewer than tile numbers
    found = table(document_seeds(docs, bits, [tile, *sorted(r["size"] for r in short)]))
    pairs = found.join(seeds, "seed").groupBy("row", "item").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "seed"))).alias("hits")
    )
    pairs = pairs.join(bench, "item").select("row", "doc_id", "item_id", "size", "hits.at", "hits.seed", "seeds")

    def scan(batches):
        for batch in batches:
            at, doc, item = ([np.array(v.as_py(), np.int64) for v in batch.column(i)] for i in (4, 5, 6))
            sizes = batch.column(3).to_pylist()
            found = [tiles(a, d.view(_U), s.view(_U), min(tile, n)) for a, d, s, n in zip(at, doc, item, sizes)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(list(map(len, found)), pa.int64()), pa.array([sum(t[2] for t in f) for f in found], pa.int64())],
                names=["row", "doc_id", "item_id", "item_words", "n_tiles", "covered_words"],
            )

    return pairs.mapInArrow(scan, "row long, doc_id long, item_id long, item_words long, n_tiles long, covered_words long")


def contaminated(docs: DataFrame, items: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, n_tiles, covered_words, coverage): where tiles cover enough of an item."""
    found = overlaps(docs, items, tile).withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    return found.filter(F.col("coverage") >= coverage).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that cover no benchmark item; rows without an id stay."""
    found = table(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
