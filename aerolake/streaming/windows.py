"""Temporal chunks on a stream of frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolake.operators.partition import MAX_OVERLAP_RATIO

_STATE = T.StructType([T.StructField("frames", T.ArrayType(T.LongType())), T.StructField("chunk", T.LongType())])


def stream_temporal_chunks(stream: DataFrame, max_size: int, ratio: float, scene: str = "scene", frame: str = "frame",
                           event_time: str = "ts", delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Members (scene, chunk_id, frame, role) of overlapping windows, emitted when a window is full.

    The state of a scene is the frames of the open window. A scene idle for ``idle_ms`` of event time past the watermark
    emits its last, short window, if that has any frame the window before lacks, and forgets its state. Frames behind the
    watermark are dropped and counted (``late_rows``).
    """
    r = min(max(float(ratio), 0.0), MAX_OVERLAP_RATIO)
    over = min(max(0, math.ceil(max_size * r) if r > 0 else 0), max_size - 1)
    out = T.StructType([T.StructField("scene", stream.schema[scene].dataType), T.StructField("chunk_id", T.LongType()),
                        T.StructField("frame", T.LongType()), T.StructField("role", T.StringType())])

    step = max_size - over

    def emit(key, frames: np.ndarray, chunk: int, windows: int, size: int) -> pd.DataFrame:
        """``windows`` windows of ``size`` frames, ``step`` apart; the first is window ``chunk`` of the scene."""
        i, j = np.divmod(np.arange(windows * size), size)
        shared = (j < over) & (chunk + i > 0)
        return pd.DataFrame({"scene": key, "chunk_id": chunk + i, "frame": frames[i * step + j], "role": np.where(shared, "overlap", "core")})

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, chunk = state.get if state.exists else ([], 0)
        frames = np.asarray(frames, np.int64)
        if state.hasTimedOut:
            state.remove()
            if len(frames) > (over if chunk > 0 else 0):
                yield emit(k[0], frames, chunk, 1, len(frames))
            return
        pdf = pd.concat(list(parts)).sort_values([event_time, frame], kind="stable")
        frames = np.concatenate([frames, pdf[frame].to_numpy(np.int64)])
        full = (len(frames) - max_size) // step + 1 if len(frames) >= max_size else 0
        if full:
            yield emit(k[0], frames, chunk, full, max_size)
        state.update((frames[full * step:].tolist(), chunk + full))
        latest = int(pdf[event_time].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)

    s = stream.withWatermark(event_time, delay).select(scene, frame, event_time)
    return s.groupBy(scene).applyInPandasWithState(update, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
