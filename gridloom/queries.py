"""A query for each operator of the array engine, over volumes made of the test tables, with its SQL.

The volumes: orders, f8, 25 x 24 x n by order key; part sizes, u1, likewise; counts of line items, u2;
embeddings, f4, one row of cells for each vector; event values, f8, whose last slab is cut off. Regions are
cut to the shape of the volume at hand.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import api, grid
from gridloom.functions import coordinates
from gridloom.meta import ArrayMeta
from gridloom.operators import regions

Query = Callable[[SparkSession, str], DataFrame]
BOX = ((3, 5, 2), (20, 17, 21))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; in local mode one of our own where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.removeprefix('file://') if shared else tempfile.mkdtemp(prefix='gridloom-')}/array-{uuid.uuid4().hex}"


def box_in(shape: grid.Triple) -> tuple[grid.Triple, grid.Triple]:
    """BOX as far as it lies within a shape."""
    return BOX[0], tuple(map(min, BOX[1], shape))  # type: ignore[return-value]


def _dense(rows: DataFrame, key: str, value: str, dtype: str) -> tuple[DataFrame, tuple, str]:
    last = rows.agg(F.max(key)).first()[0]
    k = F.col(key).cast("bigint")
    voxels = rows.select((k % 25).alias("d0"), (F.expr(f"cast({key} as bigint) div 25") % 24).alias("d1"), F.expr(f"cast({key} as bigint) div 600").alias("d2"), F.col(value).alias("value"))
    return voxels, (25, 24, last // 600 + 1), dtype


def orders(spark: SparkSession, sf_dir: str):
    return _dense(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_totalprice", "<f8")


def parts(spark: SparkSession, sf_dir: str):
    return _dense(spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_size", F.col("p_size").cast("smallint")), "p_partkey", "p_size", "|u1")


def items(spark: SparkSession, sf_dir: str):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.expr("cast(l_orderkey div 1000 as bigint)").alias("d0"), F.expr("cast(l_partkey % 24 as bigint)").alias("d1"), F.expr("cast(l_linenumber - 1 as bigint)").alias("d2"))
    rows = rows.agg(F.count("*").cast("int").alias("value"))
    a, b, c = rows.agg(*(F.max(d) for d in ("d0", "d1", "d2"))).first()
    return rows, (a + 1, b + 1, c + 1), "<u2"


def vectors(spark: SparkSession, sf_dir: str):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value"))
    a, b = rows.agg(F.max("d0"), F.max("d1")).first()
    return rows.select("d0", F.col("d1").cast("bigint"), F.lit(0).cast("bigint").alias("d2"), F.col("value").cast("float")), (a + 1, b + 1, 1), "<f4"


def events(spark: SparkSession, sf_dir: str):
    return _dense(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "value", "<f8")


def stored(spark: SparkSession, volume: tuple, **options) -> str:
    voxels, shape, dtype = volume
    path = scratch(spark)
    api.write_array(spark, path, voxels, shape=shape, dtype=options.pop("dtype", dtype), **({"chunks": (16, 16, 16)} | options))
    return path


def roundtrip(make, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = api.read_array(spark, stored(spark, make(spark, sf_dir), **options))
        kind = dict(rows.dtypes)["value"]
        return rows.withColumn("value", F.col("value").cast("int" if kind == "smallint" else kind))

    return query


def reading(layout: dict | None = None, **options) -> Query:
    return lambda spark, sf_dir: api.read_array(spark, stored(spark, orders(spark, sf_dir), **(layout or {})), **options)


def reading_box(one_based: bool = False, rebase: bool = False, **layout) -> Query:
    """BOX of the volume of orders, stored in a layout."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        volume = orders(spark, sf_dir)
        start, end = box_in(volume[1])
        path = stored(spark, volume, **layout)
        if one_based:
            return api.read_array(spark, path, bbox=(*(a + 1 for a in start), *end))
        return api.read_array(spark, path, start, end, rebase=rebase)

    return query


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on coordinates prune chunks before any file is opened, and hold in any case."""
    return regions.region(api.read_array(spark, stored(spark, orders(spark, sf_dir)), pushdown=True), *BOX)


def missing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last events end within a slab: cells are missing there, and with chunks of one slab whole chunks."""
    return api.read_array(spark, stored(spark, events(spark, sf_dir), chunks=(16, 16, 1), fill_value=-3, order="C"))


def metadata_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    api.create_array(path, (40, 24, 18), chunks=(16, 16, 16))
    return api.read_array(spark, path)


def sparse_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros over a chunk that was there erase it."""
    voxels, shape, dtype = orders(spark, sf_dir)
    path = stored(spark, (voxels, shape, dtype))
    zeros = regions.box(spark, (0, 0, 0), (16, 16, 1)).withColumn("value", F.lit(0.0))
    low = voxels.where("d0 < 16 and d1 < 16 and d2 between 1 and 15").withColumn("value", F.lit(0.0))
    api.write_array(spark, path, zeros.union(low), start=(0, 0, 0), end=(16, 16, min(16, shape[2])))
    return api.read_array(spark, path)


def sparse_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks of zeros are read as fill with the option sparse."""
    path = scratch(spark)
    api.create_array(path, (32, 16, 16), "<f8", chunks=(16, 16, 16), fill_value=7)
    api.write_array(spark, path, regions.box(spark, (0, 0, 0), (16, 16, 16)).withColumn("value", F.lit(0.0)), start=(0, 0, 0), end=(16, 16, 16))
    return api.read_array(spark, path, sparse=True)


def region_write(start: grid.Triple, end: grid.Triple, **options) -> Query:
    """Values of a region are negated in place; the rest of the touched chunks stays."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        voxels, shape, dtype = orders(spark, sf_dir)
        last = tuple(map(min, end, shape))
        path = stored(spark, (voxels, shape, dtype), **options)
        api.write_array(spark, path, voxels.where(regions.inside(start, last)).withColumn("value", -F.col("value")), start=start, end=last)
        return api.read_array(spark, path)

    return query


def region_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of an array that is not there makes one that reaches to the region's end."""
    voxels, shape, dtype = orders(spark, sf_dir)
    path = scratch(spark)
    api.write_array(spark, path, voxels.where("d0 >= 2"), start=(2, 0, 0), end=shape, dtype=dtype, chunks=(4, 4, 4))
    return api.read_array(spark, path)


def bbox_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box counted from 1, written over an array of another type: its cells are cast to the stored type."""
    voxels, shape, _ = parts(spark, sf_dir)
    path = stored(spark, (voxels, shape, "<f4"), order="C")
    start, end = (4, 5, 0), (20, 17, shape[2])
    new = voxels.where(regions.inside(start, end)).withColumn("value", (F.col("value") * 7 + 0.5).cast("double"))
    api.write_array(spark, path, new, bbox=(*(a + 1 for a in start), *end), cast=True)
    return api.read_array(spark, path)


def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole write that keeps the layout of the array that was there; the layout comes with the cells."""
    voxels, shape, dtype = orders(spark, sf_dir)
    path = stored(spark, parts(spark, sf_dir), order="C", cname="gzip", dimension_separator="/", chunks=(8, 8, 8))
    api.write_array(spark, path, voxels, shape=shape, dtype=dtype, inherit=True)
    layout = api.describe_array(spark, path).select("order", "cname", "dimension_separator", F.col("chunks")[0].alias("chunk"))
    return api.read_array(spark, path).crossJoin(F.broadcast(layout))  # one row


def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of every stored chunk, those beyond the shape too: they hold the fill value."""
    rows = api.read_array(spark, stored(spark, parts(spark, sf_dir), fill_value=7, order="C"), view="chunks")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c0, c1, c2, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                d = np.indices((16, 16, 16)).reshape(3, -1) + 16 * np.array([[c0], [c1], [c2]])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in d.astype(np.int64)), pa.array(np.frombuffer(payload, np.uint8).astype(np.int32))], ["d0", "d1", "d2", "byte"])

    return rows.select("c0", "c1", "c2", "payload").mapInArrow(spread, "d0 long, d1 long, d2 long, byte int")


def foreign_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that another writer compressed: gzip files of two members, and zlib streams under gzip's name."""
    path = stored(spark, orders(spark, sf_dir), cname="gzip")
    names = regions.chunk_list(spark, api.open_array(path)).select("name")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import zlib

        for batch in batches:
            for name in batch.column("name").to_pylist():
                place = os.path.join(path, name)
                if os.path.exists(place):
                    with open(place, "rb") as f:
                        data = gzip.decompress(f.read())
                    half = len(data) // 2
                    with open(place, "wb") as f:
                        f.write(zlib.compress(data) if name.endswith("0") else gzip.compress(data[:half]) + gzip.compress(data[half:]))
            yield batch

    names.mapInArrow(again, "name string").count()
    return api.read_array(spark, path)


def cast_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts times 200 into bytes: they wrap."""
    voxels, shape, _ = items(spark, sf_dir)
    rows = api.read_array(spark, stored(spark, (voxels.withColumn("value", F.col("value") * 200), shape, "|u1")))
    return rows.withColumn("value", F.col("value").cast("int"))


KINDS = ("u1", "u2", "f4", "f8")


def cast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversions between all types as columns."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = (F.col("o_orderkey") * 37).cast("bigint")
    x = F.col("o_totalprice") / 1e4
    given = {"u1": (n % 256).cast("smallint"), "u2": (n % 65536).cast("int"), "f4": x.cast("float"), "f8": x}
    rows = rows.select("o_orderkey", *(c.alias(k) for k, c in given.items()))
    out = {f"{a}_to_{b}": coordinates.cast_stored(F.col(a), a, b) for a in KINDS for b in KINDS if a != b}
    return rows.select("o_orderkey", *((c if k.endswith(("f4", "f8")) else c.cast("int")).alias(k) for k, c in out.items()))


def cast_stored_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversions by writes: volumes of every type read back, and written as every other type."""
    out = None
    for a in KINDS:
        voxels, shape, _ = parts(spark, sf_dir)
        voxels = voxels.withColumn("value", (F.col("value") * 5 + 0.25).cast({"u1": "smallint", "u2": "int", "f4": "float", "f8": "double"}[a]))
        given = api.read_array(spark, stored(spark, (voxels, shape, f"<{a}" if a != "u1" else "|u1")))
        for b in KINDS:
            if a != b:
                got = api.read_array(spark, stored(spark, (given, shape, f"<{b}" if b != "u1" else "|u1"), fill_value=0))
                got = got.select(F.lit(f"{a}_to_{b}").alias("cast"), "d0", "d1", "d2", F.col("value").cast("double").alias("value"))
                out = got if out is None else out.union(got)
    return out


SHARDED = {"chunks": (32, 32, 32), "chunk_shape": (16, 16, 16)}
PLAIN = ArrayMeta(shape=(40, 24, 18), chunks=(16, 16, 16), subfolders=(2, 0, 1))
SHARDS = ArrayMeta(shape=(70, 40, 40), shard=True, **SHARDED)


def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.chunk_list(spark, PLAIN, (5, 3, 7), (37, 20, 17)).drop("path")


def chunk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.chunk_list(spark, PLAIN).select("c0", "c1", "c2", "path")


def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.chunk_list(spark, PLAIN).select("name")
    return rows.select("name", *coordinates.parse_chunk_name(F.col("name")))


def shard_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.chunk_list(spark, SHARDS, (33, 0, 0), (70, 40, 10)).select("c0", "c1", "c2", "shard", "position", "shard_number")


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = api.read_array(spark, stored(spark, orders(spark, sf_dir)), view="chunks")
    return rows.select("c0", "c1", "c2", F.octet_length("payload").cast("int").alias("bytes"))


def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What results being DataFrames is for: an aggregation by chunk over a region."""
    volume = orders(spark, sf_dir)
    path = stored(spark, volume)
    rows = api.read_array(spark, path, *box_in(volume[1]))
    return rows.groupBy(*coordinates.chunk_coords(api.open_array(path))).agg(F.count("*").alias("cells"), F.min("value").alias("least"), F.max("value").alias("most"))


def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the volume of part sizes, whose last slab is cut off."""
    voxels, shape, _ = parts(spark, sf_dir)
    return regions.fill_missing(voxels.withColumn("value", F.col("value").cast("int")), (0, 0, 0), shape, -1.0)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels, _, _ = orders(spark, sf_dir)
    return regions.merge(voxels.where("d0 < 20"), voxels.where("d0 >= 10").withColumn("value", -F.col("value")))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    api.create_array(path, (40, 24, 18), chunks=(16, 16, 16), cname="zstd", fill_value=3)
    rows = api.describe_array(spark, path)
    return rows.select("dtype", "order", "cname", "clevel", "dimension_separator", "fill_value", "shard", *(F.col(n)[i].alias(f"{n}{i}") for n in ("shape", "chunks", "files") for i in range(3)))


CODECS = ("gzip", "lz4", "lz4hc", "blosclz", "zlib", "zstd")


def queries() -> dict[str, Query]:
    return {
        "full_roundtrip_u1": roundtrip(parts),
        "full_roundtrip_u2": roundtrip(items),
        "full_roundtrip_f4": roundtrip(vectors, chunks=(64, 64, 1)),
        "full_roundtrip_f8": roundtrip(orders),
        **{f"codec_{c}": roundtrip(orders, cname=c, clevel=5) for c in CODECS},
        "order_F": roundtrip(orders, order="F"),
        "order_C": roundtrip(orders, order="C"),
        "sep_slash": roundtrip(orders, dimension_separator="/"),
        "subfolders": roundtrip(orders, subfolders=(2, 0, 1)),
        "big_endian": roundtrip(orders, dtype=">f8"),
        "region_read": reading_box(),
        "region_read_c_order": reading_box(order="C"),
        "region_read_slash": reading_box(dimension_separator="/"),
        "region_read_subfolders": reading_box(subfolders=(2, 0, 1), order="C"),
        "region_start_only": reading(start=(20, 20, 1)),
        "region_end_only": reading(end=(9, 24, 2)),
        "bbox_1based": reading_box(one_based=True),
        "rebase": reading_box(rebase=True),
        "axis_swap": reading(swap_axes=True),
        "pushdown_read": pushed,
        "missing_fill": missing_fill,
        "metadata_only": metadata_only,
        "sparse_zero": sparse_zero,
        "sparse_read": sparse_read,
        "region_write": region_write((0, 0, 0), (16, 16, 16)),
        "region_write_unaligned": region_write((5, 3, 1), (23, 20, 17)),
        "region_write_c_order": region_write((5, 3, 1), (23, 20, 17), order="C"),
        "region_create": region_create,
        "shard_roundtrip": roundtrip(orders, **SHARDED),
        "shard_region_read": reading_box(**SHARDED),
        "shard_region_write": region_write((5, 3, 1), (23, 20, 17), **SHARDED),
        "bbox_write": bbox_write,
        "inherited_layout": inherited,
        "chunk_bytes": chunk_bytes,
        "foreign_streams": foreign_streams,
        "cast_on_write": cast_on_write,
        "cast_stored_arrays": cast_stored_arrays,
        "cast_columns": cast_columns,
        "chunk_list": chunk_list,
        "chunk_paths": chunk_paths,
        "parsed_names": parsed_names,
        "shard_positions": shard_positions,
        "chunk_view": chunk_view,
        "chunk_statistics": chunk_statistics,
        "fill_missing": fill_missing,
        "merge_voxels": merged,
        "describe_array": described,
    }


def _cells(table: str, key: str, value: str) -> str:
    return f"""cells AS (
  SELECT k % 25 AS d0, (k // 25) % 24 AS d1, k // 600 AS d2, {value} AS value, {key} IS NOT NULL AS given
  FROM (SELECT unnest(range((SELECT (max({key}) // 600 + 1) * 600 FROM {table}))) AS k) LEFT JOIN {table} ON {key} = k)"""


def oracle_sql() -> dict[str, str]:
    cells = "WITH " + _cells("orders", "o_orderkey", "coalesce(o_totalprice, 0.0)")
    whole = f"{cells} SELECT d0, d1, d2, value FROM cells"
    box = "d0 >= 3 AND d0 < 20 AND d1 >= 5 AND d1 < 17 AND d2 >= 2 AND d2 < 21"
    odd = "d0 >= 5 AND d0 < 23 AND d1 >= 3 AND d1 < 20 AND d2 >= 1 AND d2 < 17"
    negated = f"{cells} SELECT d0, d1, d2, CASE WHEN {odd} AND given THEN -value ELSE value END AS value FROM cells"
    counted = "SELECT l_orderkey // 1000 AS d0, l_partkey % 24 AS d1, CAST(l_linenumber - 1 AS BIGINT) AS d2, count(*) AS n FROM lineitem GROUP BY ALL"
    grid_of = f"""WITH counted AS ({counted}), axes AS (
  SELECT unnest(range((SELECT max(d0) + 1 FROM counted))) AS d0), a1 AS (SELECT unnest(range((SELECT max(d1) + 1 FROM counted))) AS d1),
  a2 AS (SELECT unnest(range((SELECT max(d2) + 1 FROM counted))) AS d2)"""
    every = "FROM axes CROSS JOIN a1 CROSS JOIN a2 LEFT JOIN counted USING (d0, d1, d2)"
    chunks = "SELECT unnest(range({0}, {1})) AS {2}"

    def grid_rows(low, high):
        return ", ".join(f"({chunks.format(a, b, f'c{i}')}) AS t{i}" for i, (a, b) in enumerate(zip(low, high, strict=True)))

    ints = "CAST(c0 AS INTEGER) AS c0, CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2"
    out = dict.fromkeys(["full_roundtrip_f8", *(f"codec_{c}" for c in CODECS), "order_F", "order_C", "sep_slash", "subfolders", "big_endian", "shard_roundtrip", "foreign_streams"], whole)
    out |= dict.fromkeys(["region_read", "region_read_c_order", "region_read_slash", "region_read_subfolders", "bbox_1based", "pushdown_read", "shard_region_read"], f"{whole} WHERE {box}")
    out |= dict.fromkeys(["region_write_unaligned", "region_write_c_order", "shard_region_write"], negated)
    out["full_roundtrip_u1"] = f"WITH {_cells('part', 'p_partkey', 'CAST(coalesce(p_size, 0) AS INTEGER)')} SELECT d0, d1, d2, value FROM cells"
    out["full_roundtrip_u2"] = f"{grid_of} SELECT d0, d1, d2, CAST(coalesce(n, 0) AS INTEGER) AS value {every}"
    out["full_roundtrip_f4"] = "SELECT vec_id AS d0, CAST(unnest(range(len(embedding))) AS BIGINT) AS d1, CAST(0 AS BIGINT) AS d2, unnest(embedding) AS value FROM embeddings"
    out["region_start_only"] = f"{whole} WHERE d0 >= 20 AND d1 >= 20 AND d2 >= 1"
    out["region_end_only"] = f"{whole} WHERE d0 < 9 AND d2 < 2"
    out["rebase"] = f"{cells} SELECT d0 - 3 AS d0, d1 - 5 AS d1, d2 - 2 AS d2, value FROM cells WHERE {box}"
    out["axis_swap"] = f"{cells} SELECT d1 AS d0, d0 AS d1, d2, value FROM cells"
    out["missing_fill"] = f"WITH {_cells('events', 'event_id', 'value')} SELECT d0, d1, d2, CASE WHEN given THEN value ELSE -3.0 END AS value FROM cells"
    out["metadata_only"] = "SELECT k % 40 AS d0, k // 40 % 24 AS d1, k // 960 AS d2, CAST(0 AS INTEGER) AS value FROM (SELECT unnest(range(40 * 24 * 18)) AS k)"
    out["sparse_zero"] = f"{cells} SELECT d0, d1, d2, CASE WHEN d0 < 16 AND d1 < 16 AND d2 < 16 THEN 0.0 ELSE value END AS value FROM cells"
    out["sparse_read"] = "SELECT k % 32 AS d0, k // 32 % 16 AS d1, k // 512 AS d2, CAST(7 AS DOUBLE) AS value FROM (SELECT unnest(range(32 * 16 * 16)) AS k)"
    out["region_write"] = f"{cells} SELECT d0, d1, d2, CASE WHEN d0 < 16 AND d1 < 16 AND d2 < 16 AND given THEN -value ELSE value END AS value FROM cells"
    out["region_create"] = f"{cells} SELECT d0, d1, d2, CASE WHEN d0 >= 2 THEN value ELSE 0.0 END AS value FROM cells"
    out["cast_on_write"] = f"{grid_of} SELECT d0, d1, d2, CAST(coalesce(n, 0) * 200 % 256 AS INTEGER) AS value {every}"
    given = "SELECT o_orderkey, CAST(o_orderkey * 37 % 256 AS INTEGER) AS u1, CAST(o_orderkey * 37 % 65536 AS INTEGER) AS u2, CAST(o_totalprice / 1e4 AS FLOAT) AS f4, o_totalprice / 1e4 AS f8 FROM orders"
    into = {"u1": "CAST(trunc({0}) AS INTEGER) % 256", "u2": "CAST(trunc({0}) AS INTEGER)", "f4": "CAST({0} AS FLOAT)", "f8": "CAST({0} AS DOUBLE)"}
    out["cast_columns"] = f"SELECT o_orderkey, {', '.join(f'{into[b].format(a)} AS {a}_to_{b}' for a in KINDS for b in KINDS if a != b)} FROM ({given})"
    sizes_at = "WITH " + _cells("part", "p_partkey", "CAST(coalesce(p_size, 0) AS INTEGER)")
    as_kind = {"u1": "trunc(x) % 256", "u2": "trunc(x)", "f4": "x", "f8": "x"}
    pairs = [f"SELECT '{a}_to_{b}' AS \"cast\", d0, d1, d2, CAST({as_kind[b].replace('x', as_kind[a])} AS DOUBLE) AS value FROM grown" for a in KINDS for b in KINDS if a != b]
    out["cast_stored_arrays"] = f"{sizes_at}, grown AS (SELECT d0, d1, d2, CASE WHEN given THEN value * 5 + 0.25 ELSE 0 END AS x FROM cells) {' UNION ALL '.join(pairs)}"
    out["bbox_write"] = f"{sizes_at} SELECT d0, d1, d2, CAST(CASE WHEN given AND d0 >= 4 AND d0 < 20 AND d1 >= 5 AND d1 < 17 THEN value * 7 + 0.5 ELSE value END AS FLOAT) AS value FROM cells"
    out["inherited_layout"] = f"{cells} SELECT d0, d1, d2, value, 'C' AS \"order\", 'gzip' AS cname, '/' AS dimension_separator, CAST(8 AS INTEGER) AS chunk FROM cells"
    out["chunk_bytes"] = f"""{sizes_at}, blocks AS (SELECT DISTINCT d0 // 16 AS c0, d1 // 16 AS c1, d2 // 16 AS c2 FROM cells WHERE given),
  every AS (SELECT c0 * 16 + k // 256 AS d0, c1 * 16 + k // 16 % 16 AS d1, c2 * 16 + k % 16 AS d2 FROM blocks, (SELECT unnest(range(4096)) AS k))
SELECT d0, d1, d2, CAST(CASE WHEN given THEN value ELSE 7 END AS INTEGER) AS byte FROM every LEFT JOIN cells USING (d0, d1, d2)"""
    out["chunk_list"] = f"SELECT {ints}, concat_ws('.', c0, c1, c2) AS name FROM {grid_rows((0, 0, 0), (3, 2, 2))}"
    out["chunk_paths"] = f"SELECT {ints}, concat(c0 // 2, '_0_', c2, '/', c0, '.', c1, '.', c2) AS path FROM {grid_rows((0, 0, 0), (3, 2, 2))}"
    out["parsed_names"] = f"SELECT concat_ws('.', c0, c1, c2) AS name, {ints} FROM {grid_rows((0, 0, 0), (3, 2, 2))}"
    out["shard_positions"] = f"SELECT {ints}, concat_ws('.', c0 // 2, c1 // 2, c2 // 2) AS shard, CAST(c0 % 2 * 4 + c1 % 2 * 2 + c2 % 2 AS INTEGER) AS position, c0 // 2 * 4 + c1 // 2 * 2 + c2 // 2 AS shard_number FROM {grid_rows((2, 0, 0), (6, 4, 2))}"
    out["chunk_view"] = f"{cells} SELECT CAST(d0 // 16 AS INTEGER) AS c0, CAST(d1 // 16 AS INTEGER) AS c1, CAST(d2 // 16 AS INTEGER) AS c2, CAST(16 * 16 * 16 * 8 AS INTEGER) AS bytes FROM cells WHERE given GROUP BY ALL"
    out["chunk_statistics"] = f"{cells} SELECT CAST(d0 // 16 AS INTEGER) AS c0, CAST(d1 // 16 AS INTEGER) AS c1, CAST(d2 // 16 AS INTEGER) AS c2, count(*) AS cells, min(value) AS least, max(value) AS most FROM cells WHERE {box} GROUP BY 1, 2, 3"
    out["fill_missing"] = f"{sizes_at} SELECT d0, d1, d2, CASE WHEN given THEN value ELSE -1 END AS value FROM cells"
    out["merge_voxels"] = f"{cells} SELECT d0, d1, d2, CASE WHEN d0 >= 10 THEN -value ELSE value END AS value FROM cells WHERE given"
    sizes = {"shape": (40, 24, 18), "chunks": (16, 16, 16), "files": (3, 2, 2)}
    columns = ", ".join(f"CAST({v} AS INTEGER) AS {n}{i}" for n, values in sizes.items() for i, v in enumerate(values))
    out["describe_array"] = f"SELECT '<u2' AS dtype, 'F' AS \"order\", 'zstd' AS cname, CAST(5 AS INTEGER) AS clevel, '.' AS dimension_separator, CAST(3 AS DOUBLE) AS fill_value, false AS shard, {columns}"
    return out
