"""Bloom filters of bounded size over 64-bit fingerprints.

A filter only ever spares work: what it lets through by mistake is counted and thrown out
later. So its size is fixed; with more keys than it holds well it spares less, and no result
depends on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^26 bits, 8 MB: one key in 40 passes by mistake with 5 million keys in it.
BITS = 26


def _slots(fingerprint: str, bits: int):
    low = F.col(fingerprint).bitwiseAND((1 << bits) - 1)
    return F.array(low, F.shiftrightunsigned(fingerprint, 64 - bits))


def build(keys: DataFrame, fingerprint: str = "fp", bits: int = BITS) -> np.ndarray:
    """The filter of a table's fingerprints: words of 64 bits. Bits meet by word before they
    come to the driver, at most 2^(bits - 6) rows."""
    slot = F.explode(_slots(fingerprint, bits)).alias("slot")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    cells = keys.select(slot).select(F.shiftright("slot", 6).alias("cell"), one.alias("mask")).groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return out


def holds(table: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Which fingerprints may be among the keys; all that are."""
    bits = np.uint64(len(table).bit_length() + 5)
    found = np.ones(len(fingerprints), bool)
    for slot in (fingerprints & np.uint64((1 << int(bits)) - 1), fingerprints >> (np.uint64(64) - bits)):
        found &= (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return found
