"""Operators over voxel tables: regions, re-basing, axis swap, fill, merging, and the chunks of a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import grid
from gridloom.functions import coordinates
from gridloom.meta import ArrayMeta

AXES = ("d0", "d1", "d2")


def inside(start: grid.Triple, end: grid.Triple) -> Column:
    test = F.lit(True)
    for d, a, b in zip(AXES, start, end, strict=True):
        test &= (F.col(d) >= a) & (F.col(d) < b)
    return test


def region(voxels: DataFrame, start: grid.Triple, end: grid.Triple, meta: ArrayMeta | None = None) -> DataFrame:
    """Voxels in [start, end). With meta, a table that has chunk columns c0, c1 and c2 is cut by those as well."""
    if meta is not None and {"c0", "c1", "c2"} <= set(voxels.columns):
        low, high = grid.touched(start, end, meta.inner)
        for c, a, b in zip(("c0", "c1", "c2"), low, high, strict=True):
            voxels = voxels.where((F.col(c) >= a) & (F.col(c) < b))
    return voxels.where(inside(start, end))


def rebase(voxels: DataFrame, start: grid.Triple) -> DataFrame:
    """Coordinates counted from start."""
    return voxels.withColumns({d: F.col(d) - s for d, s in zip(AXES, start, strict=True)})


def swap_axes(voxels: DataFrame) -> DataFrame:
    """Axes 0 and 1 exchanged, as image viewers count them."""
    return voxels.select(F.col("d1").alias("d0"), F.col("d0").alias("d1"), "d2", *(c for c in voxels.columns if c not in AXES))


def box(spark: SparkSession, low: grid.Triple, high: grid.Triple, names: tuple[str, str, str] = AXES) -> DataFrame:
    """Every coordinate of a box, made on the executors."""
    _, n1, n2 = grid.extent(low, high)
    n = grid.extent(low, high)[0] * n1 * n2
    rows = spark.range(n)
    return rows.select((F.expr(f"id div {n1 * n2 or 1}") + low[0]).alias(names[0]), (F.expr(f"id div {n2 or 1} % {n1 or 1}") + low[1]).alias(names[1]), (F.expr(f"id % {n2 or 1}") + low[2]).alias(names[2]))


def fill_missing(voxels: DataFrame, start: grid.Triple, end: grid.Triple, fill: float) -> DataFrame:
    """All cells of a region, with fill where there is no voxel."""
    kind = voxels.schema["value"].dataType
    return box(voxels.sparkSession, start, end).join(voxels, list(AXES), "left").withColumn("value", F.coalesce("value", F.lit(fill).cast(kind)))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Voxels of both; new ones win."""
    both = old.withColumnRenamed("value", "_old").join(new.withColumnRenamed("value", "_new"), list(AXES), "full_outer")
    return both.select(*AXES, F.coalesce("_new", "_old").alias("value"))


def cast_stored(voxels: DataFrame, source: str, target: str) -> DataFrame:
    return voxels.withColumn("value", coordinates.cast_stored(F.col("value"), source, target))


def chunk_list(spark: SparkSession, meta: ArrayMeta, start=None, end=None) -> DataFrame:
    """c0, c1, c2, name and path of the chunks that a region touches, in sharded arrays of whole shards.

    Sharded arrays have shard, position and number in shard columns too.
    """
    first, last = grid.region(meta.shape, start, end)
    low, high = grid.touched(first, last, meta.chunks)
    if meta.shard:
        low, high = (tuple(v * p for v, p in zip(x, meta.chunks_per_shard, strict=True)) for x in (low, high))
    rows = box(spark, low, high, ("c0", "c1", "c2")).select(*(F.col(c).cast("int").alias(c) for c in ("c0", "c1", "c2")))
    rows = rows.withColumn("name", coordinates.chunk_name(meta.dimension_separator))
    if not meta.shard:
        return rows.withColumn("path", coordinates.chunk_path(meta))
    rows = rows.withColumns({"shard": coordinates.shard_name(meta), "position": coordinates.shard_position(meta)})
    shards = rows.select("*", *coordinates.shard_coords(meta))
    return shards.withColumns({"shard_number": coordinates.shard_number(meta), "path": coordinates.chunk_path(meta, ("s0", "s1", "s2"))}).drop("s0", "s1", "s2")


def describe(spark: SparkSession, meta: ArrayMeta) -> DataFrame:
    """The metadata as one row."""
    row = (list(meta.shape), list(meta.chunks), meta.dtype, meta.order, meta.cname, meta.clevel, meta.dimension_separator, float(meta.fill_value), list(meta.subfolders), meta.shard, list(meta.inner), list(meta.files), list(meta.chunks_per_shard))
    schema = "shape array<int>, chunks array<int>, dtype string, `order` string, cname string, clevel int, dimension_separator string, fill_value double, subfolders array<int>, shard boolean, inner array<int>, files array<int>, chunks_per_shard array<int>"
    return spark.createDataFrame([row], schema)
