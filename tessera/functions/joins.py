"""Join helpers: broadcast only sides with a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row bound under which a side is broadcast.  The check reads at most
# ``max_rows + 1`` rows, so it stays cheap on large inputs.
DEFAULT_BROADCAST_ROWS = 200_000


def is_bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """True iff ``df`` has at most ``max_rows`` rows (checked with a limit)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side proven to hold at most ``max_rows`` rows;
    otherwise the side is returned unchanged and Spark shuffles (AQE may still
    convert the join at runtime from real statistics)."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df
