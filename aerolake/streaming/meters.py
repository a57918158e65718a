"""Rolling meters: statistics of the last values of a series, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolake.functions.ranking import grouped_rank, grouped_running_sum

_BLOCK = 4096


def rolling_meter(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value", window: int = 20) -> DataFrame:
    """Per row: lower median, mean, max and value of the last ``window`` rows, and the running total and count.

    The series is cut into blocks, each with the last rows of the block before it, so a window never sees a whole series.
    """
    by = list(by)
    r = grouped_rank(df.select(*by, *order, value), by, order, "rk")
    blk = F.floor(F.col("rk") / _BLOCK)
    halo = F.when(F.col("rk") % _BLOCK >= _BLOCK - window + 1, F.array(blk, blk + 1)).otherwise(F.array(blk))
    h = r.withColumn("__b", F.explode(halo)).withColumn("__own", F.col("__b") == blk)
    w = Window.partitionBy(*by, "__b").orderBy("rk").rowsBetween(-(window - 1), 0)
    h = h.withColumn("__l", F.array_sort(F.collect_list(value).over(w))).withColumn("mean", F.avg(value).over(w)).where("__own")
    h = h.withColumns({"median": F.get("__l", F.floor((F.size("__l") - 1) / 2).cast("int")), "max": F.element_at("__l", -1)})
    run = grouped_running_sum(h.drop("__b", "__own", "__l"), by, ["rk"], value, "__before")
    return run.select(*by, *order, F.col(value).alias("value"), "median", "mean", "max", (F.col("__before") + F.col(value)).alias("total"),
                      (F.col("rk") + 1).alias("count"))


_STATE = T.StructType([T.StructField("last", T.ArrayType(T.DoubleType())), T.StructField("total", T.DoubleType()), T.StructField("count", T.LongType())])


def stream_rolling_meter(stream: DataFrame, key: str, order: str, value: str = "value", window: int = 20, event_time: str | None = None,
                         delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The same statistics on a stream; the state of a series is its last ``window`` values, total and count.

    Rows of one trigger are taken in ``order``; rows that arrive in a later trigger count as later. With ``event_time``, the
    state of a series without a row for ``idle_ms`` of event time past the watermark goes, and the series starts anew when it
    comes back; rows behind the watermark are dropped and counted (``late_rows``). Without it, state is kept for good.
    """
    types = {f.name: f.dataType for f in stream.schema}
    out = T.StructType([T.StructField(key, types[key]), T.StructField(order, types[order])] + [
        T.StructField(c, T.DoubleType()) for c in ("value", "median", "mean", "max", "total")] + [T.StructField("count", T.LongType())])

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, total, count = state.get if state.exists else ([], 0.0, 0)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        new = rows[value].to_numpy(float)
        # windows over the kept values and the new ones; places before the start of the series are blank
        kept = np.asarray(last, float)[-(window - 1):] if window > 1 else np.zeros(0)
        seen = count + 1 + np.arange(len(new))
        full = np.concatenate([np.full(window - 1 - len(kept), np.inf), kept, new])
        view = np.lib.stride_tricks.sliding_window_view(full, window)
        held = np.minimum(seen, window)
        blank = np.arange(window)[None, :] < (window - held)[:, None]
        middle = np.sort(view, axis=1)[np.arange(len(new)), (held - 1) // 2]
        sums = np.cumsum(np.concatenate([[total], new]))[1:]
        yield pd.DataFrame({
            key: k[0], order: rows[order].to_numpy(), "value": new, "median": middle, "mean": np.where(blank, 0.0, view).sum(axis=1) / held,
            "max": np.where(blank, -np.inf, view).max(axis=1), "total": sums, "count": seen})
        state.update((full[-window:][-min(count + len(new), window):].tolist(), float(sums[-1]), count + len(new)))
        if event_time is not None:
            latest = int(rows["__at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)

    if event_time is None:
        return stream.select(key, order, value).groupBy(key).applyInPandasWithState(update, out, _STATE, "append", GroupStateTimeout.NoTimeout)
    timed = stream.select(key, order, value, F.col(event_time).alias("__at")).withWatermark("__at", delay)
    return timed.groupBy(key).applyInPandasWithState(update, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
