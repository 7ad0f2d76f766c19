"""Element extraction for grids that keep arriving.

Labelling needs one frame at a time only, so new grid files are processed as
micro-batches with the batch operators and appended to the element tables; the
linking stages then run over those tables.  A file must hold whole frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridtrack.config import TrackConfig
from gridtrack.operators.elements import find_elements
from gridtrack.operators.raster import Raster, mask_temperature

GRID_SCHEMA = "frame int, ts timestamp_ntz, r int, c int, lat double, lon double, tb double"


def stream_elements(spark: SparkSession, source: str, target: str, checkpoint: str, rows: DataFrame,
                    cols: DataFrame, config: TrackConfig, files_per_batch: int = 64) -> StreamingQuery:
    """Append the elements and element pixels of new grid files below ``target``.

    ``rows`` and ``cols`` are the axis tables of the grid.  Each batch writes
    its own folder, so a repeated batch after a failure replaces itself.
    """
    grid = (
        spark.readStream.schema(GRID_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )

    def process(batch: DataFrame, number: int) -> None:
        frames = batch.groupBy("frame").agg(F.min("ts").alias("ts"))
        raster = Raster(mask_temperature(batch, config), rows, cols, frames)
        found = find_elements(raster, config)
        found.accepted.write.mode("overwrite").parquet(f"{target}/elements/batch={number}")
        found.pixels.write.mode("overwrite").parquet(f"{target}/element_pixels/batch={number}")

    return (
        grid.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
