"""Byte-level BPE by given ranks: overlapping chunk encoding, and decoding by joining raw bytes.

A text of up to ``CHUNK`` code points is one piece. A longer one becomes rows: chunks that overlap are cut
into pre-tokens in parallel, each from its own start. A chunk that starts inside a pre-token soon falls into
step: from the first boundary it has in common with the chunk before it in the overlap, both
agree for good, because a pre-token depends on nothing left of its start. Texts are cut there, where
also no white space touches the cut, so that the piece on the left is split the same without what
follows. Chunks without such a boundary (a run of letters or spaces longer than the overlap) stay
joined with the next. The pieces are then encoded in parallel and their ids joined in order.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundtrace.llm.store import documents, prepare, table

CHUNK = 1 << 16  # code points
OVERLAP = 1 << 12
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def rank_lines(spark: SparkSession, path: str) -> list[bytes]:
    """Lines ``base64(token) rank`` of a vocabulary file: tens of thousands, whatever the corpus."""
    with open(path, "rb") as file:
        return file.read().splitlines()


class Codec:
    """Encoder and decoder; the tables are built by the first batch of a task."""

    def __init__(self, lines: list[bytes], pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.by_id[rank] = token

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoded(rows: DataFrame, lines, pattern: str, keep: str) -> DataFrame:
    """Replace the last column, a text, by ``ids``: little-endian unsigned 32-bit numbers."""

    def scan(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(lines.value, pattern)
            last = batch.num_columns - 1
            ids = [codec.encode(t or "") for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(ids, pa.binary())], names=[*batch.schema.names[:last], "ids"])

    return rows.mapInArrow(scan, f"{keep}, ids binary")


def _boundaries(chunks: DataFrame, pattern: str, overlap: int, chunk: int) -> DataFrame:
    """Add ``head`` and ``tail``: safe cuts (offsets in the text) in the two overlaps of a chunk."""

    def scan(batches):
        import regex

        find = regex.compile(pattern)
        for batch in batches:
            starts, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            heads, tails = [], []
            for begin, text in zip(starts, texts):
                head, tail = [], []
                size = len(text)
                for match in find.finditer(text):
                    at = match.start()
                    # The last pre-token may go on beyond the chunk; its start is certain, its end is not.
                    if 0 < at and (at < overlap or at >= chunk) and not text[at - 1].isspace() and (
                        not text[at].isspace() or (text[at] == " " and match.end() - at > 1 and not text[at + 1].isspace())
                    ):
                        if match.end() < size:
                            (head if at < overlap else tail).append(begin + at)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "head", "tail"],
            )

    return chunks.mapInArrow(scan, "row long, doc_id long, begin long, part string, head array<long>, tail array<long>")


def long_pieces(rows: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, piece, text): texts longer than a chunk, cut where their encoding is independent."""
    count = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    parts = rows.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("k")).select(
        "row", "doc_id", (F.col("k").cast("long") * chunk).alias("begin"),
        F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("part"),
    )
    marked = table(_boundaries(parts.repartition("row", "begin"), pattern, overlap, chunk))
    of_row = Window.partitionBy("row").orderBy("begin")
    # Cuts are few numbers; the texts join them afterwards, so no window holds a text.
    common = F.array_min(F.array_intersect(F.lag("tail").over(of_row), F.col("head")))
    cuts = marked.select("row", "begin", common.alias("cut"))
    cuts = cuts.withColumn("next", F.lead("cut").over(of_row))
    cuts = table(cuts.withColumn("piece", F.count("cut").over(of_row)))
    first = F.coalesce("cut", "begin")
    last = F.coalesce("next", F.col("begin") + chunk)
    own = marked.select("row", "doc_id", "begin", "part").join(cuts, ["row", "begin"])
    own = own.withColumn("from", (first - F.col("begin") + 1).cast("int")).withColumn("size", (last - first).cast("int"))
    own = own.withColumn("part", F.expr("substring(part, from, size)"))
    joined = own.groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("begin", "part"))).alias("parts"))
    return joined.select("row", "doc_id", F.col("piece").cast("long").alias("piece"), F.array_join("parts.part", "").alias("text"))


def encode(docs: DataFrame, lines: list[bytes], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the ids of every row's whole text, 4 bytes each, little-endian.

    Null texts count as empty and have no ids. Repeated rows and ids are rows of their own; other
    columns are ignored; an empty table gives no rows. No special token is recognised.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(lines)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = _encoded(texts.filter(F.length("text") <= chunk), sent, pattern, "doc_id long")
    rows = texts.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = long_pieces(table(rows), pattern, chunk, overlap)
    done = _encoded(pieces, sent, pattern, "row long, doc_id long, piece long")
    done = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("all"))
    joined = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["ids"])), ""))
    return short.unionByName(done.select("doc_id", joined.alias("ids")))


def decode(encoded: DataFrame, lines: list[bytes], pattern: str) -> DataFrame:
    """Add ``decoded``: the tokens' bytes joined (they need not be whole characters)."""
    sent = encoded.sparkSession.sparkContext.broadcast(lines)

    def scan(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(sent.value, pattern)
            raw = [codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, lines: list[bytes], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, lines, pattern, chunk, overlap), lines, pattern)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def public_ranks(spark: SparkSession, name: str = VOCABULARY) -> tuple[list[bytes], str]:
    """The ranks and the pre-token pattern of an installed public vocabulary."""
    import public_tokenizers

    return rank_lines(spark, public_tokenizers.path(name)), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir, "doc_id", "text"), *public_ranks(spark))
