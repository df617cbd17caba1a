"""Image folders as micro-batches. An extension: the operators themselves are bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..params import DEFAULT, Params
from ..plans.segmentation import filter_pixels
from ..sources.images import PIXELS, parse_pnm  # noqa: F401


def filter_stream(spark: SparkSession, files: DataFrame, to_pixels: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, p: Params = DEFAULT) -> StreamingQuery:
    """Filter the pixels of every micro-batch of ``files`` and append them to ``target`` as Parquet, once a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        filter_pixels(to_pixels(rows), p).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
