"""A bit map of 64-bit tokens, of bounded size whatever the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 1 << 26  # bits: 8 MB


def bit_map(tokens: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """Set the bits of the low hash bits of ``tokens`` (token): 128 bits a token, at most ``longest`` in all.

    Only the map reaches the driver, never the tokens. Where tokens outgrow it, more bits are set than
    need be; callers take a set bit as "maybe".
    """
    bits = 1 << 16
    while bits < min(128 * tokens.count(), longest):
        bits <<= 1
    slots = tokens.select(F.col("token").bitwiseAND(bits - 1).alias("slot"))
    parts = slots.groupBy(F.expr("slot >> 6").alias("at")).agg(F.expr("bit_or(1L << int(slot & 63))").alias("bits"))
    rows = parts.toArrow()  # columns of numbers: 16 bytes a row, at most LONGEST / 64 rows
    out = np.zeros(bits >> 6, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def maybe(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``tokens`` have their bit set."""
    slot = (tokens & np.uint64(len(bits) * 64 - 1)).view(np.int64)
    return ((bits[slot >> 6] >> (slot & 63)) & 1).astype(bool)
