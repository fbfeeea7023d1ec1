"""Joins by counted size: a side is broadcast only when it was counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Rows that a broadcast side has at most.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a table that is counted from its files, hinted for broadcast only if it is small; otherwise the join shuffles.

    The side is made once, whatever it is made from.
    """
    written, n = scratch.counted(df, "side")
    return F.broadcast(written) if n <= rows else written
