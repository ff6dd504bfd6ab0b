"""Creating, reading and writing arrays; results of reads are DataFrames, or NumPy arrays where asked for."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom import grid
from gridloom.meta import FILE, ArrayMeta
from gridloom.operators import regions
from gridloom.plans import packing
from gridloom.shipping import ship
from gridloom.sources import files, journal
from gridloom.sources.array_source import NAME, GridSource

#: Defaults of created arrays, and of arrays written without metadata before.
CREATED = {"cname": "lz4", "clevel": 5, "order": "F", "chunks": (256, 256, 256)}
WRITTEN = {"cname": "zstd", "clevel": 1, "order": "F", "chunks": (256, 256, 256)}


def register(spark: SparkSession, pushdown: bool = False) -> None:
    """Make the data source known to a session, and the package to its workers.

    With pushdown, the session offers predicates to Python data sources from then on, which Spark does not by default.
    """
    ship(spark)
    spark.dataSource.register(GridSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def open_array(path: str) -> ArrayMeta:
    return journal.opened(path)


def exists(path: str) -> bool:
    journal.recover(path)
    return os.path.isfile(os.path.join(os.path.expanduser(path), FILE))


def _layout(options: dict) -> dict:
    """Options as fields of ArrayMeta; a chunk_shape makes a sharded array."""
    out = {k: v for k, v in options.items() if v is not None}
    if out.get("chunk_shape") is not None:
        out["shard"] = True
    unknown = set(out) - set(ArrayMeta.__dataclass_fields__)
    if unknown:
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    return out


def create_array(path: str, shape: Sequence[int], dtype: str = "<u2", **options) -> ArrayMeta:
    """Write an array's metadata alone; all its cells are fill_value.

    options: chunks, chunk_shape, cname, clevel, order, dimension_separator, subfolders, fill_value.
    """
    meta = ArrayMeta(shape=shape, dtype=dtype, **(CREATED | _layout(options)))
    meta.save(path)
    return meta


def read_array(spark: SparkSession, path: str, start=None, end=None, *, bbox=None, view: str = "voxels", sparse: bool = False, rebase: bool = False, pushdown: bool = False, swap_axes: bool = False, partition_bytes: int | None = None) -> DataFrame:
    """Voxels (d0, d1, d2, value), or chunks with view="chunks", of an array or a region of it.

    start and end are half-open from 0; bbox counts from 1 and includes its ends. swap_axes exchanges axes 0 and 1.
    """
    path = os.path.expanduser(path)
    if not exists(path):
        raise FileNotFoundError(f"metadataFileMissing:{os.path.join(path, FILE)}")
    register(spark, pushdown)
    read = spark.read.format(NAME).option("view", view).option("sparse", sparse).option("rebase", rebase).option("pushdown", pushdown)
    read = read.option("min_partitions", spark.sparkContext.defaultParallelism)
    for key, value in (("start", start), ("end", end), ("bbox", bbox)):
        if value is not None:
            read = read.option(key, " ".join(map(str, value)))
    if partition_bytes is not None:
        read = read.option("partition_bytes", partition_bytes)
    rows = read.load(path)
    return regions.swap_axes(rows) if swap_axes else rows


def to_array(spark: SparkSession, path: str, start=None, end=None, *, bbox=None) -> np.ndarray:
    """A region as an F-ordered array on the driver, brought there as whole chunks."""
    meta = open_array(path)
    if bbox is not None:
        start, end = grid.bbox_to_region(bbox)
    start, end = grid.region(meta.shape, start, end)
    out = np.full([b - a for a, b in zip(start, end, strict=True)], meta.fill, order="F")
    if not out.size:
        return out
    for row in read_array(spark, path, start, end, view="chunks").toLocalIterator():
        block = files.cells(meta, bytes(row.payload))
        base = [c * k for c, k in zip((row.c0, row.c1, row.c2), meta.inner, strict=True)]
        low = [max(a, b) for a, b in zip(start, base, strict=True)]
        high = [min(e, b + k) for e, b, k in zip(end, base, meta.inner, strict=True)]
        if all(a < b for a, b in zip(low, high, strict=True)):
            out[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, start, strict=True))] = block[tuple(slice(a - o, b - o) for a, b, o in zip(low, high, base, strict=True))]
    return out


def _stored_type(data: np.ndarray) -> str:
    kind = f"{data.dtype.kind}{data.dtype.itemsize}"
    return ("|" if data.dtype.itemsize == 1 else ">" if data.dtype.byteorder == ">" else "<") + kind


def _cube(data) -> np.ndarray:
    data = np.asarray(data)
    if data.ndim > 3 or not data.size:
        raise ValueError("data needs at most three axes and at least one cell")
    return data.reshape(data.shape + (1,) * (3 - data.ndim))


def _publish(blocks: DataFrame, path: str, meta: ArrayMeta, overwrite: bool) -> None:
    register(blocks.sparkSession)
    blocks.write.format(NAME).mode("overwrite" if overwrite else "append").option("metadata", json.dumps(meta.document())).save(os.path.expanduser(path))


def write_array(spark: SparkSession, path: str, data, start=None, end=None, *, shape=None, dtype: str | None = None, sparse: bool = True, inherit: bool = False, cast: bool = False, bbox=None, **options) -> ArrayMeta:
    """Write a whole array, or with start, end or bbox a region of one.

    data is a NumPy array of at most three axes, or a DataFrame of voxels, which needs shape and dtype. A
    whole write replaces the array; with inherit it keeps the layout of the one there. A region that names
    no array creates one whose shape is the region's end. A region's data must have the stored dtype, or
    cast converts it. With sparse, blocks that are all fill have no file.
    """
    rows = data if isinstance(data, DataFrame) else None
    cube = None if rows is not None else _cube(data)
    if bbox is not None:
        start, end = grid.bbox_to_region(bbox)
    if start is not None or end is not None:
        first = tuple(start) if start is not None else (0, 0, 0)
        last = tuple(end) if end is not None and any(end) else tuple(a + n for a, n in zip(first, cube.shape, strict=True)) if cube is not None else None
        return _write_region(spark, path, rows, cube, first, last, dtype, sparse, cast, options)
    layout = WRITTEN | _layout(options)
    if cube is not None:
        shape, dtype = cube.shape, dtype or _stored_type(cube)
    elif shape is None or dtype is None:
        raise ValueError("voxels need shape and dtype")
    meta = ArrayMeta(shape=shape, dtype=dtype, **layout)
    if inherit and exists(path):
        meta = open_array(path).with_(shape=meta.shape, dtype=meta.dtype)
    return _write(spark, path, rows, cube, meta, (0, 0, 0), meta.shape, sparse, merge=False)


def _write_region(spark, path, rows, cube, start, end, dtype, sparse, cast, options) -> ArrayMeta:
    if end is not None and any(b <= a for a, b in zip(start, end, strict=True)):
        raise ValueError("Invalid start_coords or end_coords!")
    if exists(path):
        meta = open_array(path)
        start, end = grid.region(meta.shape, start, end)
    else:
        if end is None:
            raise ValueError("a region of a new array needs its end")
        given = dtype or (_stored_type(cube) if cube is not None else None)
        if given is None:
            raise ValueError("voxels need a dtype")
        meta = ArrayMeta(shape=end, dtype=given, **(WRITTEN | _layout(options)))
        meta.save(path)
    if cube is not None:
        if cube.shape != tuple(b - a for a, b in zip(start, end, strict=True)):
            raise ValueError(f"data has shape {cube.shape}, the region {tuple(b - a for a, b in zip(start, end, strict=True))}")
        if cube.dtype.newbyteorder("=") != meta.native and not cast:
            raise ValueError(f"data is {cube.dtype}, the array {meta.dtype}; cast=True converts")
    return _write(spark, path, rows, cube, meta, start, end, sparse, merge=True)


def _write(spark, path, rows, cube, meta, start, end, sparse, merge) -> ArrayMeta:
    ship(spark)
    parts = packing.fragments(rows, meta, start, end) if rows is not None else packing.dense_fragments(spark, cube, meta, start)
    blocks = packing.assembled(parts, meta, path, merge, sparse, packing.tasks_for(spark, meta, start, end))
    _publish(blocks, path, meta, overwrite=not merge)
    return meta


def describe_array(spark: SparkSession, path: str) -> DataFrame:
    return regions.describe(spark, open_array(path))
