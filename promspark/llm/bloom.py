"""A bitmap of fixed largest size that tells most absent 64-bit hashes from present ones.

It goes to the tasks of a scan so that they pass on few rows; the exact join
follows, so a larger input only lets more rows through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, LEAST_BITS, MOST_BITS, PROBES = 32, 1 << 22, 1 << 27, 3


def bitmap(keys: DataFrame, column: str, count: int) -> np.ndarray:
    """Bytes of the bitmap of a column of hashes; at most MOST_BITS whatever ``count`` is."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < BITS_PER_KEY * count:
        bits *= 2
    probes = F.array(*[F.shiftrightunsigned(column, 20 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)])
    places = keys.select(F.explode(probes).alias("p"))
    cells = places.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    got = cells.toArrow()  # a row per 64 bits at most
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def probe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Indexes of the values that may be in the bitmap."""
    last, kept = np.uint64(len(bits) * 8 - 1), np.arange(len(values))
    for k in range(PROBES):
        p = (values[kept] >> np.uint64(20 * k)) & last
        kept = kept[(bits[(p >> np.uint64(3)).view(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return kept


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in the key column of ``gone``; rows with a null key stay.

    Rows that the bitmap tells apart are kept where they are; only the others, the rows to drop and
    few more, are shuffled for the exact anti-join."""
    bits = bitmap(gone.select(F.xxhash64(key).alias("h")), "h", gone.count())

    @F.arrow_udf("boolean")
    def perhaps(hashes: pa.Array) -> pa.Array:
        out = np.zeros(len(hashes), bool)
        out[probe(bits, hashes.to_numpy(zero_copy_only=False).view(np.uint64))] = True
        return pa.array(out)

    flag = perhaps(F.xxhash64(key))
    return rows.where(~flag).unionByName(rows.where(flag).join(gone.select(key), key, "left_anti").select(*rows.columns))
