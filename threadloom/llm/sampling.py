"""Bounded samples of rows for fitting; nothing but models is made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: str, limit: int, seed: int, total: int) -> DataFrame:
    """At most ``limit`` rows in the order of the hash of ``key``.

    total: the rows' number or more. Rows beyond the hash share that surely holds enough are left
    out where they are read, so what one task sorts grows with the limit, not with the table.
    """
    h = F.xxhash64(key, F.lit(seed))
    share = min(1.0, 1.5 * limit / max(1, total))
    near = rows if share >= 1 else rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(h, key).limit(limit)
