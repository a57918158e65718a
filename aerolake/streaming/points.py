"""Point streams: voxel thinning within a watermark, and coverage fill chunk by chunk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aerolake.functions import linalg as L
from aerolake.operators.sampling import with_cells
from aerolake.session import materialize

#: Cells on a side of a block of the owner table of coverage fill.
BLOCK_CELLS = 64


def stream_voxel_first(stream: DataFrame, size: float, delay: str, event_time: str = "ts", by: Sequence[str] = ("scene",)) -> DataFrame:
    """First point per voxel that arrives; the voxel is closed until the watermark passes the point's time by ``delay``; its
    state goes at the end of that trigger, and the next point is emitted again. Rows behind the watermark are dropped and counted (``late_rows``). One
    row of state per voxel, kept in the JVM; of points that arrive in one trigger any may be the first."""
    s = with_cells(stream.withWatermark(event_time, delay), size)
    return s.dropDuplicatesWithinWatermark([*by, "cx", "cy", "cz"])


def _block(by: Sequence[str]) -> Column:
    """Name of the square of BLOCK_CELLS x BLOCK_CELLS cells that a cell lies in."""
    side = lambda c: F.floor(F.col(c) / BLOCK_CELLS).cast("string")
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by], side("cx"), side("cy"))


def known_owners(spark: SparkSession, owners_dir: str, schema: T.StructType, blocks: Sequence[str], batch_id: int) -> DataFrame:
    """Owners that batches before ``batch_id`` elected for the cells of ``blocks``; other blocks' files are not opened. A repeated
    batch may have written its rows twice, so each cell is taken once."""
    held = spark.read.schema(schema).parquet(owners_dir).where(F.col("block").isin(list(blocks)) & (F.col("batch") < batch_id))
    keys = [c for c in schema.names if c not in ("own", "batch", "block")]
    return held.groupBy(*keys).agg(F.min("own").alias("own"))


def start_coverage_fill(stream: DataFrame, base: DataFrame, grid: float, out: str, checkpoint: str, by: Sequence[str] = ("scene",),
                        order: str = "chunk_order", trigger: Mapping[str, str | bool] | None = None) -> StreamingQuery:
    """Write the points of cells that neither ``base`` nor an earlier chunk occupies to ``out``/points; returns the query.

    The state is a table of cell owners beside the output, in folders by block of cells. A batch reads the blocks that it
    touches only, and a block holds each of its cells once, so what a trigger reads follows its own area and not the number of
    triggers before it. It elects owners for its free cells (lowest chunk), joins its points with them and appends; point
    folders carry the batch id, so a repeated batch overwrites its own work only. All of it is joins and aggregates, so a crowded
    cell does not sit in one task. The names of the touched blocks (at most one per point of the trigger, of
    BLOCK_CELLS squared cells each) go through the driver. The cells of ``base`` are written once. ``trigger`` is passed
    on to the writer; without it the query ends with the data at hand.
    """
    by = list(by)
    keys = [*by, "cx", "cy"]
    finite = lambda df: df.where(L.finite("x") & L.finite("y") & L.finite("z"))
    used = with_cells(finite(base), grid, ("x", "y")).select(*keys).distinct()
    used = materialize(used, "base-cells")
    owners_dir, points_dir = f"{out}/owners", f"{out}/points"

    def fill(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        c = with_cells(finite(batch), grid, ("x", "y"))
        new = c.groupBy(*keys).agg(F.min(order).alias("own")).join(used, keys, "left_anti")
        new = materialize(new.withColumn("block", _block(by)), "touched-cells")
        owners = fresh = new.drop("block")
        if batch_id > 0:
            schema = T.StructType([*fresh.schema.fields, T.StructField("batch", T.LongType()), T.StructField("block", T.StringType())])
            blocks = [r["block"] for r in new.select("block").distinct().collect()]
            known = known_owners(spark, owners_dir, schema, blocks, batch_id)
            fresh = fresh.join(known, keys, "left_anti")
            owners = fresh.unionByName(known)
        owners = materialize(owners, "owners")
        fresh = fresh.join(new.select(*keys, "block"), keys)
        fresh.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("append").partitionBy("block").parquet(owners_dir)
        keep = c.join(owners, keys).where(F.col(order) == F.col("own")).drop("cx", "cy", "own")
        keep.write.mode("overwrite").parquet(f"{points_dir}/batch={batch_id}")

    return stream.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
