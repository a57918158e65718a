"""What a running or finished stream reports about its state."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped by stateful operators, over the triggers the query still remembers
    (``spark.sql.streaming.numRecentProgressUpdates``)."""
    dropped = {p.batchId: sum(op.numRowsDroppedByWatermark for op in p.stateOperators) for p in query.recentProgress}
    return sum(dropped.values())


def state_rows(query: StreamingQuery) -> int:
    """Rows of state held after the last trigger that reported any."""
    held = [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    return held[-1] if held else 0
