"""How the corpus operators choose between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few longs that are broadcast (24 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialized table if its counted size allows (the count reads file footers only).

    Otherwise both sides of the join are plain scans, which AQE splits where a key is hot.
    """
    return F.broadcast(df) if df.count() <= rows else df
