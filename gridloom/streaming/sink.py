"""Voxel streams into an array: each micro-batch is merged as one region write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.readwriter import DataStreamWriter

from gridloom import api
from gridloom.meta import ArrayMeta


def merge_stream(voxels: DataFrame, path: str) -> DataStreamWriter:
    """A writer that merges (d0, d1, d2, value) rows into an array that is there; later batches win.

    A batch that is run again after a failure writes the same cells again. Within a batch, a cell given
    several times has the value of the largest.
    """
    meta: ArrayMeta = api.open_array(path)

    def merge(batch: DataFrame, _: int) -> None:
        cells = batch.groupBy("d0", "d1", "d2").agg({"value": "max"}).toDF("d0", "d1", "d2", "value")
        api.write_array(batch.sparkSession, path, cells, start=(0, 0, 0), end=meta.shape)

    return voxels.writeStream.foreachBatch(merge)
