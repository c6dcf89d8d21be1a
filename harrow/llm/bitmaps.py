"""A filter of fixed size in front of a join: drop rows whose key cannot have a partner.

The keys of one side become a bitmap of BITS bits, whatever their number. Rows of
the other side whose bit is not set cannot match and are not shuffled. A full
bitmap drops nothing; the join behind it decides in any case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.session import shuffles_dropped

BITS = 1 << 26
_PART = 4096 * 8


def bit_numbers(values: np.ndarray) -> np.ndarray:
    """The bit of each 64-bit value."""
    return (values.astype(np.int64) & (BITS - 1)).astype(np.int64)


def bitmap_of(frame: DataFrame, column: str):
    """The bitmap of a column of 64-bit hashes, broadcast to all tasks: BITS / 8 bytes."""
    bit = F.col(column).bitwiseAND(F.lit(BITS - 1))
    parts = frame.groupBy(F.floor(bit / _PART).alias("part")).agg(
        F.bitmap_construct_agg(F.pmod(bit, F.lit(_PART))).alias("bits")
    )
    whole = np.zeros(BITS // 8, np.uint8)
    with shuffles_dropped(frame.sparkSession):
        found = parts.collect()
    for row in found:
        raw = np.frombuffer(row["bits"], np.uint8)
        whole[row["part"] * 4096 : row["part"] * 4096 + len(raw)] = raw
    return frame.sparkSession.sparkContext.broadcast(whole)


def hits(whole: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the bitmap."""
    bit = bit_numbers(values)
    return (whole[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

