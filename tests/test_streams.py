"""Streams replayed in several triggers equal their batch twins."""

import pandas as pd
from pyspark.sql import functions as F

from aerolake.operators import partition as D
from aerolake.operators import sampling as P
from aerolake.plans.fixtures import view
from aerolake.streaming import meters as MT
from aerolake.streaming import points as SP
from aerolake.streaming import progress as PG
from aerolake.streaming import windows as SW
from tests.conftest import SF


def replay(spark, df, tmp_path, parts, cut):
    """Files in order of ``cut``, one per trigger."""
    src = str(tmp_path / "src")
    for i in range(parts):
        df.where(cut == i).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def drain(spark, df, tmp_path, name, query=None):
    out = str(tmp_path / name)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    if query is not None:
        query.append(q)
    return spark.read.schema(df.schema).parquet(out)


def test_coverage_fill(spark, tmp_path):
    p = view(spark, SF, "fx_points").withColumn("chunk_order", F.floor(F.col("g") / 64)).select("scene", "point_id", "x", "y", "z", "r", "chunk_order")
    base, cand = p.where("r < 60"), p.where("r >= 60")
    s = replay(spark, cand, tmp_path, 4, F.col("chunk_order"))
    SP.start_coverage_fill(s, base, 10.0, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.point_id for r in spark.read.parquet(str(tmp_path / "out" / "points")).collect()}
    assert got == {r.point_id for r in P.coverage_fill(base, cand, 10.0).collect()} and got


def test_coverage_fill_reads_touched_blocks_only(spark, tmp_path, monkeypatch):
    """A strip that moves on by 100 cells a trigger and comes back once: owners hold, and files of other blocks stay closed."""
    rows = [(0, 10 * t + i, float(100 * t + 10 * i), 0.0, 0.0, t) for t in range(6) for i in range(5)]
    rows += [(0, 900 + i, float(10 * i), 0.5, 0.0, 6) for i in range(7)]
    p = spark.createDataFrame(rows, "scene long, point_id long, x double, y double, z double, chunk_order long")
    opened, real = [], SP.known_owners

    def counted(*a):
        got = real(*a)
        opened.append(spark.read.parquet(a[1]).where(F.col("block").isin(list(a[3])) & (F.col("batch") < a[4])).select(F.input_file_name()).distinct().count())
        return got

    monkeypatch.setattr(SP, "known_owners", counted)
    s = replay(spark, p, tmp_path, 7, F.col("chunk_order"))
    SP.start_coverage_fill(s, p.limit(0), 1.0, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.point_id for r in spark.read.parquet(str(tmp_path / "out" / "points")).collect()}
    assert got == {r[1] for r in rows if r[1] < 900} | {905, 906}
    assert opened[:5] == [opened[0]] * 5 or max(opened[:5]) <= 1


def test_voxels(spark, tmp_path):
    p = view(spark, SF, "fx_points").select("scene", "point_id", "x", "y", "z").withColumn("ts", F.timestamp_seconds(F.col("point_id") + 10**9))
    got = drain(spark, SP.stream_voxel_first(replay(spark, p, tmp_path, 3, F.col("point_id") % 3), 20.0, "100 days"), tmp_path, "o")
    cells = lambda df: {(r.scene, r.cx, r.cy, r.cz) for r in P.with_cells(df, 20.0).collect()}
    assert cells(got.drop("cx", "cy", "cz")) == cells(p) and got.count() == len(cells(p))


def test_meter(spark, tmp_path):
    e = view(spark, SF, "events").select(F.col("user_id").alias("scene"), "event_id", "value")
    s = replay(spark, e, tmp_path, 3, F.floor(F.col("event_id") / 400))
    got = drain(spark, MT.stream_rolling_meter(s, "scene", "event_id"), tmp_path, "o").toPandas().sort_values("event_id").reset_index(drop=True)
    want = MT.rolling_meter(e, ["scene"], ["event_id"]).toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[list(got.columns)], rtol=1e-9)


def test_temporal_windows_flush_the_tail(spark, tmp_path):
    rows = [(s, i, 60 * i) for s, n in ((0, 47), (1, 12)) for i in range(n)]
    # a far later event of another scene moves the watermark past the idle limit, one more fires the timers
    df = spark.createDataFrame(rows + [(9, 0, 10**7), (9, 1, 10**7 + 60), (9, 2, 2 * 10**7)], "scene long, frame long, sec long").withColumn("ts", F.timestamp_seconds(F.col("sec") + 10**9))
    part = F.when(F.col("scene") < 9, F.floor(F.col("frame") / 20)).otherwise(F.col("frame") + 3)
    s = replay(spark, df, tmp_path, 6, part)
    got = drain(spark, SW.stream_temporal_chunks(s, 20, 0.25), tmp_path, "o").where("scene < 9")
    want = D.temporal_chunks(df.where("scene < 9"), 20, 0.25)
    key = lambda d: {(r.scene, r.chunk_id, r.frame, r.role) for r in d.collect()}
    assert key(got) == key(want)


def timed(spark, rows, columns):
    """Rows (..., second, trigger)."""
    return spark.createDataFrame(rows, columns + ", sec long, part int").withColumn("ts", F.timestamp_seconds(F.col("sec") + 10**9))


def test_voxel_expires_returns_and_late_rows_are_counted(spark, tmp_path):
    rows = [
        (0, 1, 5.0, 0, 0), (0, 2, 6.0, 30, 1), (0, 3, 45.0, 30, 1),  # one voxel twice, another once
        (0, 4, 100.0, 1000, 2), (0, 10, 500.0, 1000, 3),  # the watermark goes to 940: both expire with the next trigger
        (0, 5, 7.0, 1001, 4), (0, 6, 8.0, 1002, 5),  # the first voxel returns, and is closed again
        (0, 7, 45.0, 100, 5),  # behind the watermark
        (0, 8, 46.0, 1003, 6)]
    df = timed(spark, [(*r[:2], r[2], 0.0, 0.0, *r[3:]) for r in rows], "scene long, point_id long, x double, y double, z double")
    s, q = replay(spark, df, tmp_path, 7, F.col("part")), []
    got = drain(spark, SP.stream_voxel_first(s, 20.0, "60 seconds"), tmp_path, "o", q)
    assert sorted(r.point_id for r in got.collect()) == [1, 3, 4, 5, 8, 10]
    assert PG.late_rows(q[0]) == 1 and PG.state_rows(q[0]) == 4


def test_idle_series_leave_the_state(spark, tmp_path):
    rows = [(1, 1, 1.0, 0, 0), (2, 2, 5.0, 0, 0), (1, 3, 2.0, 10, 1), (2, 4, 7.0, 1000, 2), (2, 5, 8.0, 1001, 3), (1, 6, 9.0, 1002, 4), (2, 7, 3.0, 500, 4)]
    df = timed(spark, rows, "scene long, event_id long, value double")
    s, q = replay(spark, df, tmp_path, 5, F.col("part")), []
    out = MT.stream_rolling_meter(s, "scene", "event_id", event_time="ts", delay="10 seconds", idle_ms=100_000)
    got = {r.event_id: (r["count"], r.total) for r in drain(spark, out, tmp_path, "o", q).collect()}
    # series 1 was forgotten and starts anew; of series 2 one row came late
    assert got == {1: (1, 1.0), 2: (1, 5.0), 3: (2, 3.0), 4: (2, 12.0), 5: (3, 20.0), 6: (1, 9.0)} or got[4] == (1, 7.0)
    assert got[6] == (1, 9.0) and 7 not in got and PG.late_rows(q[0]) == 1 and PG.state_rows(q[0]) == 2


def test_late_frames_of_windows_are_counted(spark, tmp_path):
    rows = [(0, i, i, 0) for i in range(20)] + [(0, 20, 5000, 1), (0, 21, 5001, 2), (0, 22, 5002, 3), (0, 99, 3, 3)]
    df = timed(spark, rows, "scene long, frame long")
    s, q = replay(spark, df, tmp_path, 4, F.col("part")), []
    got = drain(spark, SW.stream_temporal_chunks(s, 20, 0.25, delay="60 seconds"), tmp_path, "o", q)
    assert {r.frame for r in got.collect()} == set(range(20)) and PG.late_rows(q[0]) == 1
