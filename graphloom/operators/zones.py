"""The high bits of ids: rows whose zone the other side of a join lacks needn't be exchanged.

Zones only leave out rows that can't match. Where ids have too many zones, or all
have one, nothing is left out and nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE_BITS = 48
MOST = 512


def zone(c: str) -> Column:
    return F.shiftright(F.col(c), ZONE_BITS)


def zone_pairs(df: DataFrame, a: str, b: str) -> set[tuple[int, int]] | None:
    """Zones of *a* and *b* that come together; None if there are more than MOST."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(zone(a).alias("a"), zone(b).alias("b")).distinct().limit(MOST + 1).collect()
    return None if len(rows) > MOST else {(r["a"], r["b"]) for r in rows}


def within(df: DataFrame, c: str, zones: set[int] | None) -> DataFrame:
    return df if zones is None else df.where(zone(c).isin(sorted(zones)))


def within_pairs(df: DataFrame, a: str, b: str, pairs: set[tuple[int, int]] | None) -> DataFrame:
    if pairs is None:
        return df
    code = lambda x, y: x * (1 << 16) + y
    return df.where(code(zone(a), zone(b)).isin(sorted(code(x, y) for x, y in pairs)))
