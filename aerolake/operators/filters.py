"""Scene and frame filter chains and the video timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions.ranking import first_per_group, grouped_rank


def _slice(df: DataFrame, by: Sequence[str], order: Sequence[str], spec: Sequence[int]) -> DataFrame:
    """Rows at positions start:stop[:step] of each group in order; negative ends count from the back."""
    start, stop = int(spec[0]), int(spec[1])
    step = int(spec[2]) if len(spec) == 3 else 1
    if step < 1:
        raise ValueError("slice step must be positive")
    by = list(by)
    ranked = grouped_rank(df, by, order, "__i")
    lo, hi = F.lit(start), F.lit(stop)
    if start < 0 or stop < 0:
        n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        ranked = ranked.join(n, by) if by else ranked.withColumn("__n", F.lit(ranked.count()))
        lo = F.greatest(F.lit(0), F.col("__n") + start) if start < 0 else lo
        hi = (F.col("__n") + stop) if stop < 0 else hi
    i = F.col("__i")
    return ranked.where((i >= lo) & (i < hi) & ((i - lo) % step == 0)).select(*df.columns)


def filter_scenes(scenes: DataFrame, filters: Sequence, modalities: DataFrame, states: DataFrame) -> DataFrame:
    """Apply ordered filters to ``scenes(scene, ord)``.

    A filter is 'all' or None; [start, stop] or [start, stop, step]; a list of names, which also sets the order; a
    regular expression for the whole name; or one of {'exists': m}, {'exists_not': m}, {'process_state': (key, s)},
    {'process_state_not': (key, s)}. A key with '*' is a pattern for the first process name of the scene it starts.
    """
    out = scenes
    for f in filters or ():
        if f is None or (isinstance(f, str) and f == "all"):
            continue
        if isinstance(f, dict):
            (kind, arg), = f.items()
            if kind in ("exists", "exists_not"):
                has = modalities.where(F.col("modality") == arg).select("scene").distinct()
                out = out.join(has, "scene", "left_semi" if kind == "exists" else "left_anti")
            elif kind in ("process_state", "process_state_not"):
                key, state = arg
                match = F.col("process").rlike(f"^(?:{key})") if "*" in key else F.col("process") == key
                found = first_per_group(states.where(match).select("scene", "pos", "state"), ["scene"], ["pos"])
                hit = found.where(F.col("state") == state).select("scene")
                out = out.join(hit, "scene", "left_semi" if kind == "process_state" else "left_anti")
            else:
                raise ValueError(f"unknown scene filter {kind}")
        elif isinstance(f, str):
            out = out.where(F.col("scene").rlike(f"^(?:{f})$"))
        elif all(isinstance(x, int) for x in f):
            if len(f) not in (2, 3):
                raise ValueError("a slice is [start, stop] or [start, stop, step]")
            out = _slice(out, [], ["ord", "scene"], f)
        else:
            names = F.array(*[F.lit(str(x)) for x in f])
            out = out.where(F.col("scene").isin([str(x) for x in f])).withColumn(
                "ord", F.array_position(names, F.col("scene")).cast(out.schema["ord"].dataType))
    return out


def filter_frames(frames: DataFrame, filters: Sequence, files: DataFrame) -> DataFrame:
    """Apply ordered filters to ``frames(scene, stem, ord)``: slices per scene, 'exists: m', '!exists: m', or a name prefix pattern.

    ``files`` holds (scene, modality, stem).
    """
    out = frames
    for f in filters or ():
        if f is None or (isinstance(f, str) and f == "all"):
            continue
        if isinstance(f, str):
            negate, text = f.startswith("!exists: "), f.removeprefix("!")
            if text.startswith("exists: "):
                has = files.where(F.col("modality") == text.removeprefix("exists: ")).select("scene", "stem").distinct()
                out = out.join(has, ["scene", "stem"], "left_anti" if negate else "left_semi")
            else:
                out = out.where(F.col("stem").rlike(f"^(?:{f})"))
        else:
            if len(f) not in (2, 3):
                raise ValueError("a slice is [start, stop] or [start, stop, step]")
            out = _slice(out, ["scene"], ["ord", "stem"], f)
    return out


def video_frames(segments: DataFrame) -> DataFrame:
    """One row per frame time of ``segments(scene, seg, start, end, fps)``; the end is exclusive.

    ``pos`` numbers the frames of a scene, segments in order.
    """
    n = F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start")) / (1.0 / F.col("fps")))).cast("long")
    s = segments.withColumn("__n", n)
    before = Window.partitionBy("scene").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    s = s.where("__n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("i"))
    return s.select("scene", "seg", (F.col("__b") + F.col("i")).alias("pos"),
                    (F.col("start") + F.col("i") * (1.0 / F.col("fps"))).alias("t"))
