"""From voxel rows to block files: map-side fragments, one shuffle by file, one task for each file.

A fragment holds the cells of one map batch that fall into one file, as offsets and values without
padding, so a voxel takes 4 bytes and its value in the shuffle instead of a row. Files that the new cells
do not cover are read by the task that owns them, and by no other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom import grid
from gridloom.meta import ArrayMeta
from gridloom.sources import files
from gridloom.sources.array_source import BLOCK_SCHEMA

FRAGMENT_SCHEMA = "f0 int, f1 int, f2 int, low array<int>, size array<int>, offsets binary, data binary"


def cast_cells(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    """C-like conversion among the stored types: integers wrap; floats are cut to integers and must be in range."""
    if values.dtype == kind:
        return values
    if kind.kind == "f":
        return values.astype(kind)
    if values.dtype.kind == "f":
        whole = np.trunc(values)
        if not ((whole >= 0) & (whole <= np.iinfo(kind).max)).all():
            raise ValueError(f"a value is out of range for {kind}")
        return whole.astype(kind)
    return values.astype(kind)  # modulo 2^bits


def fragments(voxels: DataFrame, meta: ArrayMeta, start: grid.Triple, end: grid.Triple) -> DataFrame:
    """Fragments of rows (d0, d1, d2, value), which must lie within [start, end)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array(meta.chunks, np.int64)
        counts = np.array(meta.files, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if any(c.null_count for c in batch.columns):
                raise ValueError("voxels cannot hold nulls")
            at = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            if (at < start).any() or (at >= end).any():
                raise ValueError(f"a voxel lies outside [{start}, {end})")
            values = cast_cells(batch.column(3).to_numpy(), meta.native)
            file, inside = at // size, at % size
            number = (file[:, 0] * counts[1] + file[:, 1]) * counts[2] + file[:, 2]
            offset = ((inside[:, 0] * size[1] + inside[:, 1]) * size[2] + inside[:, 2]).astype(np.int32)
            order = np.lexsort((offset, number))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]])
            heads = file[order[cuts[:-1]]].astype(np.int32)
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            none = pa.nulls(len(parts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(heads[:, i]) for i in range(3)), none, none, pa.array([offset[p].tobytes() for p in parts], pa.binary()), pa.array([values[p].tobytes() for p in parts], pa.binary())],
                ["f0", "f1", "f2", "low", "size", "offsets", "data"],
            )

    return voxels.select("d0", "d1", "d2", "value").mapInArrow(rows, FRAGMENT_SCHEMA)


def dense_fragments(spark: SparkSession, data: np.ndarray, meta: ArrayMeta, start: grid.Triple) -> DataFrame:
    """Fragments of an array on the driver that is to lie at start."""
    end = tuple(s + n for s, n in zip(start, data.shape, strict=True))
    data = cast_cells(data, meta.native)
    rows = []
    for file in grid.blocks(*grid.touched(start, end, meta.chunks)):
        low = [max(s, f * k) for s, f, k in zip(start, file, meta.chunks, strict=True)]
        high = [min(e, (f + 1) * k) for e, f, k in zip(end, file, meta.chunks, strict=True)]
        part = data[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, start, strict=True))]
        rows.append((*file, [a - f * k for a, f, k in zip(low, file, meta.chunks, strict=True)], list(part.shape), None, bytearray(part.tobytes())))
    return spark.createDataFrame(rows, FRAGMENT_SCHEMA)


def assembled(parts: DataFrame, meta: ArrayMeta, root: str, merge: bool, sparse: bool, tasks: int) -> DataFrame:
    """Finished files (f0, f1, f2, payload) of the fragments; payload is null where a file is all fill."""
    root = os.path.expanduser(root)

    def finished(file: grid.Triple, own: list[dict]) -> bytes | None:
        block, given, n = np.full(meta.chunks, meta.fill), np.zeros(meta.chunks, bool), 0
        for f in own:
            values = np.frombuffer(f["data"], meta.native)
            if f["offsets"] is None:
                at = tuple(slice(a, a + k) for a, k in zip(f["low"], f["size"], strict=True))
                block[at], given[at] = values.reshape(f["size"]), True
            else:
                offsets = np.frombuffer(f["offsets"], np.int32)
                block.reshape(-1)[offsets] = values
                given.reshape(-1)[offsets] = True
            n += len(values)
        if n != int(given.sum()):
            raise ValueError(f"a cell of file {grid.name(file)} is given twice")
        within = tuple(slice(0, min(k, s - f * k)) for k, s, f in zip(meta.chunks, meta.shape, file, strict=True))
        if merge and not given[within].all():
            block = np.where(given, block, files.read_file(meta, root, file))
        outside = np.ones(meta.chunks, bool)
        outside[within] = False
        block[outside] = meta.fill
        return files.encode_file(meta, block, sparse)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, own = None, []
        for batch in batches:
            for f in batch.to_pylist():
                at = (f["f0"], f["f1"], f["f2"])
                if file is not None and at != file:
                    yield made(file, own)
                    own = []
                file = at
                own.append(f)
        if file is not None:
            yield made(file, own)

    def made(file: grid.Triple, own: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in file), pa.array([finished(file, own)], pa.binary())], ["f0", "f1", "f2", "payload"])

    keys = ["f0", "f1", "f2"]
    return parts.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(rows, BLOCK_SCHEMA)


def tasks_for(spark: SparkSession, meta: ArrayMeta, start: grid.Triple, end: grid.Triple) -> int:
    """Files that a region touches, but no more than a task for each 64 MB and for each core."""
    n = prod(grid.extent(*grid.touched(start, end, meta.chunks)))
    decoded = n * prod(meta.chunks) * meta.itemsize
    return max(1, min(n, max(spark.sparkContext.defaultParallelism, decoded >> 26)))
