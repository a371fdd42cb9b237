"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longs that a broadcast list may hold in all, 8 bytes each; hashed they take three to four times that.
BROADCAST_LONGS = 4_000_000


def sent_if_small(table: DataFrame, longs: Column | None = None, limit: int = BROADCAST_LONGS) -> DataFrame:
    """A written `table`, marked for broadcast if its rows hold `limit` longs or fewer in all (`longs` a row, one by default); else as it is,
    and Spark plans a shuffled join."""
    held = table.agg(F.sum(F.lit(1) if longs is None else longs)).first()[0] or 0
    return F.broadcast(table) if held <= limit else table
