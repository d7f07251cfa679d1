"""Bitmaps of fixed size over hashed values, used to let through less before a shuffle.

They may let through too much, never too little, so an exact step always follows. Their size is a constant: on a very
large corpus they fill up and save less, but nothing that is broadcast grows.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS = 1 << 25


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits of the values' places; at most BITS / 64 rows reach the driver."""
    bit = values.select(F.pmod(F.col(column), F.lit(BITS)).alias("bit"))
    rows = (bit.selectExpr("cast(shiftright(bit, 6) as int) as w", "shiftleft(1L, cast(bit % 64 as int)) as b")
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return bits.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & np.uint64(BITS - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
