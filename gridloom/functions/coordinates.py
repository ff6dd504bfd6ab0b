"""Chunk arithmetic as Spark columns, for use over voxel and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.meta import ArrayMeta


def _each(names: tuple[str, ...], sizes: tuple[int, ...]) -> list[Column]:
    return [F.expr(f"{n} div {s}") for n, s in zip(names, sizes, strict=True)]


def chunk_coords(meta: ArrayMeta, names: tuple[str, str, str] = ("d0", "d1", "d2")) -> list[Column]:
    """c0, c1 and c2 of the inner chunk that holds a voxel."""
    return [c.cast("int").alias(f"c{i}") for i, c in enumerate(_each(names, meta.inner))]


def chunk_name(separator: str = ".", names: tuple[str, str, str] = ("c0", "c1", "c2")) -> Column:
    return F.concat_ws(separator, *(F.col(n).cast("string") for n in names))


def parse_chunk_name(name: Column) -> list[Column]:
    """c0, c1 and c2 of a chunk's name, whatever character separates them."""
    parts = F.split(name, r"[^0-9]")
    return [F.element_at(parts, i + 1).cast("int").alias(f"c{i}") for i in range(3)]


def subfolder(meta: ArrayMeta, names: tuple[str, str, str] = ("c0", "c1", "c2")) -> Column:
    if not any(meta.subfolders):
        return F.lit("")
    return F.concat_ws("_", *(F.expr(f"{n} div {s}").cast("string") if s else F.lit("0") for n, s in zip(names, meta.subfolders, strict=True)))


def chunk_path(meta: ArrayMeta, names: tuple[str, str, str] = ("c0", "c1", "c2")) -> Column:
    """Path of a block's file below the array's folder."""
    name = chunk_name(meta.dimension_separator, names)
    return F.concat_ws("/", subfolder(meta, names), name) if any(meta.subfolders) else name


def shard_coords(meta: ArrayMeta, names: tuple[str, str, str] = ("c0", "c1", "c2")) -> list[Column]:
    return [c.cast("int").alias(f"s{i}") for i, c in enumerate(_each(names, meta.chunks_per_shard))]


def shard_name(meta: ArrayMeta, names: tuple[str, str, str] = ("c0", "c1", "c2")) -> Column:
    return F.concat_ws(meta.dimension_separator, *(c.cast("string") for c in _each(names, meta.chunks_per_shard)))


def shard_position(meta: ArrayMeta, names: tuple[str, str, str] = ("c0", "c1", "c2")) -> Column:
    """Number of an inner chunk in its shard, the last axis fastest."""
    p0, p1, p2 = meta.chunks_per_shard
    a, b, c = (F.pmod(F.col(n), F.lit(p)) for n, p in zip(names, (p0, p1, p2), strict=True))
    return (a * (p1 * p2) + b * p2 + c).cast("int")


def shard_number(meta: ArrayMeta, names: tuple[str, str, str] = ("s0", "s1", "s2")) -> Column:
    """Number of a shard among all, the last axis fastest."""
    _, n1, n2 = meta.files
    a, b, c = (F.col(n).cast("long") for n in names)
    return a * (n1 * n2) + b * n2 + c


def cast_stored(value: Column, source: str, target: str) -> Column:
    """A value of stored type source as target, by C's rules: integers wrap, floats are cut and must be in range."""
    kinds = {"u1": ("smallint", 8), "u2": ("int", 16), "f4": ("float", 0), "f8": ("double", 0)}
    kind, bits = kinds[target]
    if not bits or source == target:
        return value.cast(kind)
    if source[0] == "u":
        return F.pmod(value.cast("bigint"), F.lit(1 << bits)).cast(kind)
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    good = (whole >= 0) & (whole < (1 << bits)) & ~F.isnan(value)
    return F.when(good, whole.cast("bigint")).otherwise(F.raise_error(F.lit(f"a value is out of range for {target}")).cast("bigint")).cast(kind)
