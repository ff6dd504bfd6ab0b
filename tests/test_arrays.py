from __future__ import annotations

import itertools
import json
import math
import os

import numpy as np
import pytest

import gridloom as g
from gridloom import codecs
from gridloom.functions import coordinates
from gridloom.operators import regions
from gridloom.plans.packing import cast_cells

SHAPE, CHUNKS = (40, 24, 18), (16, 16, 16)
rng = np.random.default_rng(1234567)


def cube(kind: str) -> np.ndarray:
    """Random bytes, not-a-number patterns among them."""
    return np.frombuffer(rng.bytes(math.prod(SHAPE) * int(kind[1])), kind).reshape(SHAPE)


def same(a: np.ndarray, b: np.ndarray) -> bool:
    return a.dtype == b.dtype and a.shape == b.shape and np.ascontiguousarray(a).tobytes() == np.ascontiguousarray(b).tobytes()


@pytest.mark.parametrize("order", ["F", "C"])
@pytest.mark.parametrize("kind", ["u1", "u2", "f4", "f8"])
def test_round_trip_of_bits(spark, tmp_path, kind, order):
    for i, cname in enumerate(("lz4", "zstd", "gzip") if kind == "f4" else ("lz4hc", "blosclz") if kind == "u1" else ("zlib",)):
        data = cube(kind)
        g.write_array(spark, f"{tmp_path}/{i}", data, chunks=CHUNKS, cname=cname, clevel=5, order=order, sparse=False)
        meta = g.open_array(f"{tmp_path}/{i}")
        assert (meta.shape, meta.chunks, meta.cname, meta.order, meta.kind) == (SHAPE, CHUNKS, cname, order, kind)
        assert same(g.to_array(spark, f"{tmp_path}/{i}"), data)
        assert same(g.to_array(spark, f"{tmp_path}/{i}", (0, 0, 0), (20, 24, 18)), data[:20])


def test_default_chunks_and_thin_axes(spark, tmp_path):
    for i, shape in enumerate(((40, 24, 18), (10,), (10, 10))):
        data = rng.integers(0, 200, shape).astype("u1")
        meta = g.write_array(spark, f"{tmp_path}/{i}", data)
        assert (meta.cname, meta.clevel, meta.order, meta.chunks) == ("zstd", 1, "F", (256, 256, 256))
        assert same(g.to_array(spark, f"{tmp_path}/{i}"), data.reshape(shape + (1,) * (3 - len(shape))))


def test_region_opens_the_chunks_it_touches_and_no_other(spark, tmp_path):
    data = rng.integers(1, 200, SHAPE).astype("u2")
    path = str(tmp_path / "a")
    g.write_array(spark, path, data, chunks=CHUNKS)
    names = {n for n in os.listdir(path) if n != ".zarray"}
    assert len(names) == 12
    for n in names - {"1.0.0", "1.0.1"}:
        (tmp_path / "a" / n).write_bytes(b"broken")
    rows = g.read_array(spark, path, (17, 2, 3), (32, 16, 18)).toPandas()
    assert len(rows) == 15 * 14 * 15
    assert (data[rows.d0, rows.d1, rows.d2] == rows.value).all()
    with pytest.raises(Exception, match="Decompression error"):
        g.read_array(spark, path, (0, 0, 0), (17, 2, 3)).count()


def test_pushed_predicates_prune_chunks(spark, tmp_path):
    path = str(tmp_path / "a")
    g.write_array(spark, path, rng.integers(1, 200, SHAPE).astype("u2"), chunks=CHUNKS)
    for n in os.listdir(path):
        if n[0] == "0":
            (tmp_path / "a" / n).write_bytes(b"broken")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = g.read_array(spark, path, pushdown=True).where("d0 >= 16 and d0 < 20 and d1 = 3 and d2 > 4")
        assert rows.count() == 4 * 13
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


BOXES = [((5, 3, 7), (37, 20, 17)), ((0, 0, 0), (36, 22, 17)), ((16, 0, 0), (32, 16, 16)), ((39, 23, 17), (40, 24, 18))]


@pytest.mark.parametrize("layout", [{"order": "F"}, {"order": "C"}, {"chunks": (32, 32, 32), "chunk_shape": CHUNKS}])
@pytest.mark.parametrize("box", BOXES)
def test_region_write_keeps_the_rest(spark, tmp_path, layout, box):
    start, end = box
    at = tuple(slice(a, b) for a, b in zip(start, end, strict=True))
    data = rng.integers(0, 60000, SHAPE).astype("u2")
    path = str(tmp_path / "a")
    g.write_array(spark, path, data, **({"chunks": CHUNKS} | layout))
    before = {n: (os.stat(f"{path}/{n}").st_mtime_ns, os.stat(f"{path}/{n}").st_ino) for n in os.listdir(path)}
    want = data.copy()
    want[at] ^= 0x55
    g.write_array(spark, path, want[at], start=start, end=end)
    assert same(g.to_array(spark, path), want)
    size = g.open_array(path).chunks
    for n, stamp in before.items():
        if n != ".zarray":
            block = [int(v) for v in n.split(".")]
            touched = all(b * k < e and (b + 1) * k > s for b, k, s, e in zip(block, size, start, end, strict=True))
            assert touched != (stamp == (os.stat(f"{path}/{n}").st_mtime_ns, os.stat(f"{path}/{n}").st_ino))
    assert not [n for n in os.listdir(path) if n.endswith("tmp")]


def test_region_of_a_new_array(spark, tmp_path):
    path = str(tmp_path / "a")
    data = rng.integers(1, 200, (7, 10, 2)).astype("u1")
    meta = g.write_array(spark, path, data, start=(2, 0, 0), end=(9, 10, 2), chunks=(4, 4, 4))
    assert meta.shape == (9, 10, 2)
    got = g.to_array(spark, path)
    assert same(got[2:], data) and not got[:2].any()


@pytest.mark.parametrize("order", ["F", "C"])
@pytest.mark.parametrize(("kind", "fill"), [("<u2", 1), ("<f4", -3.0), ("<f8", math.nan)])
def test_missing_chunks_are_fill(spark, tmp_path, order, kind, fill):
    path = str(tmp_path / "a")
    g.create_array(path, SHAPE, kind, chunks=CHUNKS, order=order, fill_value=fill)
    data = rng.integers(1, 200, (10, 10, 10)).astype(kind[1:])
    g.write_array(spark, path, data, start=(4, 4, 4), end=(14, 14, 14))
    want = np.full(SHAPE, fill, kind[1:])
    want[4:14, 4:14, 4:14] = data
    assert same(g.to_array(spark, path), want)
    assert sorted(os.listdir(path)) == [".zarray", "0.0.0"]
    rows = g.read_array(spark, path).toPandas()
    assert len(rows) == math.prod(SHAPE) and rows.value.notna().sum() == (0 if math.isnan(fill) else math.prod(SHAPE) - 1000) + 1000


def test_zeros_erase_a_chunk_and_overwriting_clears_the_folder(spark, tmp_path):
    path = str(tmp_path / "a")
    g.write_array(spark, path, np.ones(SHAPE, "u2"), chunks=CHUNKS)
    g.write_array(spark, path, np.zeros(CHUNKS, "u2"), start=(0, 0, 0), end=CHUNKS)
    assert "0.0.0" not in os.listdir(path) and not g.to_array(spark, path)[:16, :16, :16].any()
    (tmp_path / "a" / "notes.txt").write_text("stays")
    g.write_array(spark, path, np.ones((4, 4, 4), "u1"), chunks=CHUNKS)
    assert sorted(os.listdir(path)) == [".zarray", "0.0.0", "notes.txt"]
    g.write_array(spark, path, np.zeros((4, 4, 4), "u1"), chunks=CHUNKS, sparse=False)
    assert "0.0.0" in os.listdir(path)


def test_sparse_read(spark, tmp_path):
    path = str(tmp_path / "a")
    g.create_array(path, (4, 4, 4), "<u2", chunks=(4, 4, 4), fill_value=7)
    g.write_array(spark, path, np.zeros((4, 4, 4), "u2"), start=(0, 0, 0), end=(4, 4, 4))
    assert {r.value for r in g.read_array(spark, path).collect()} == {0}
    assert {r.value for r in g.read_array(spark, path, sparse=True).collect()} == {7}


@pytest.mark.parametrize("kind", [">u2", ">f4", ">f8"])
def test_big_endian(spark, tmp_path, kind):
    path = str(tmp_path / "a")
    data = rng.normal(100, 10, SHAPE).astype(kind)
    g.write_array(spark, path, data, chunks=CHUNKS)
    assert json.loads((tmp_path / "a" / ".zarray").read_text())["dtype"] == kind
    assert (g.to_array(spark, path) == data).all()


def test_names_folders_and_shards(spark, tmp_path):
    data = rng.integers(1, 60000, SHAPE).astype("u2")
    g.write_array(spark, f"{tmp_path}/a", data, chunks=CHUNKS, dimension_separator="/", subfolders=(2, 0, 1))
    assert (tmp_path / "a" / "1_0_1" / "2" / "1" / "1").is_file()
    assert same(g.to_array(spark, f"{tmp_path}/a"), data)
    data[:16, :16, 16:] = 0
    g.write_array(spark, f"{tmp_path}/b", data, chunks=(32, 32, 32), chunk_shape=CHUNKS)
    assert sorted(os.listdir(tmp_path / "b")) == [".zarray", "0.0.0", "1.0.0"]
    index = codecs.shard_index((tmp_path / "b" / "0.0.0").read_bytes()[-(16 * 8 + 4) :], 8)
    assert index[1] is None and index[0] is not None
    assert same(g.to_array(spark, f"{tmp_path}/b"), data)
    assert same(g.to_array(spark, f"{tmp_path}/b", (17, 2, 3), (39, 20, 18)), data[17:39, 2:20, 3:18])
    shard = bytearray((tmp_path / "b" / "1.0.0").read_bytes())
    shard[-1] ^= 1
    (tmp_path / "b" / "1.0.0").write_bytes(shard)
    with pytest.raises(Exception, match="checksum"):
        g.read_array(spark, f"{tmp_path}/b").count()


def test_conversions_among_types(spark):
    for source in ("u1", "u2", "f4", "f8"):
        for target in ("u1", "u2", "f4", "f8"):
            values = np.array([0, 1, 200], source) if source == "u1" else np.array([0, 3, 255], source)
            assert (cast_cells(values, np.dtype(target)) == values.astype(target)).all()
    assert cast_cells(np.array([300, 65535], "u2"), np.dtype("u1")).tolist() == [44, 255]
    assert cast_cells(np.array([3.9, -0.9]), np.dtype("u2")).tolist() == [3, 0]
    for bad in (-1.0, 256.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            cast_cells(np.array([bad]), np.dtype("u1"))
    rows = spark.createDataFrame([(300, 3.9), (-1, 0.0)], "n int, x double")
    got = rows.select(coordinates.cast_stored(rows.n, "u2", "u1").alias("a"), coordinates.cast_stored(rows.x, "f8", "u2").alias("b")).collect()
    assert [tuple(r) for r in got] == [(44, 3), (255, 0)]


def test_bad_arguments(spark, tmp_path):
    path = str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        g.read_array(spark, path)
    g.write_array(spark, path, np.ones(SHAPE, "u2"), chunks=CHUNKS)
    for call in (
        lambda: g.to_array(spark, path, (0, 0, 0), (41, 1, 1)),
        lambda: g.to_array(spark, path, bbox=(1, 1, 1, 41, 1, 1)),
        lambda: g.write_array(spark, path, np.ones((2, 2, 2), "u2"), start=(3, 3, 3), end=(3, 5, 5)),
        lambda: g.write_array(spark, path, np.ones((2, 2, 2), "u2"), start=(0, 0, 0), end=(3, 3, 3)),
        lambda: g.write_array(spark, path, np.ones((2, 2, 2), "f4"), start=(0, 0, 0), end=(2, 2, 2)),
        lambda: g.write_array(spark, path, np.ones((2, 2, 2), "i4")),
        lambda: g.write_array(spark, path, np.ones((0, 2, 2), "u2")),
        lambda: g.write_array(spark, path, np.ones((2, 2, 2), "u2"), order="X"),
        lambda: g.write_array(spark, path, np.ones((2, 2, 2), "u2"), cname="bz2"),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(TypeError):
        g.write_array(spark, path, np.ones((2, 2, 2), "u2"), level=3)
    assert g.to_array(spark, path).all()


def test_a_failed_write_leaves_the_array_as_it_was(spark, tmp_path):
    path = str(tmp_path / "a")
    data = np.ones(SHAPE, "u2")
    g.write_array(spark, path, data, chunks=CHUNKS)
    twice = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 0, 2)], "d0 long, d1 long, d2 long, value int")
    outside = spark.createDataFrame([(0, 0, 0, 5), (99, 0, 0, 2)], "d0 long, d1 long, d2 long, value int")
    for rows in (twice, outside):
        with pytest.raises(Exception, match="given twice|outside"):
            g.write_array(spark, path, rows, start=(0, 0, 0), end=SHAPE)
    assert same(g.to_array(spark, path), data)
    assert not [n for n in os.listdir(path) if n.endswith("tmp")]


@pytest.mark.parametrize("overwrite", [True, False])
def test_a_commit_is_all_or_nothing(spark, tmp_path, monkeypatch, overwrite):
    """Killed before the switch the array is the old one, after it the new one, wherever between the renames."""
    import pyarrow as pa

    from gridloom.sources import journal
    from gridloom.sources.array_source import GridWriter

    old, new = rng.integers(1, 200, SHAPE).astype("u2"), rng.integers(1, 200, SHAPE).astype("u2")
    meta = g.write_array(spark, str(tmp_path / "new"), new, chunks=(32, 32, 32) if overwrite else CHUNKS)
    blocks = [(*map(int, n.split(".")), (tmp_path / "new" / n).read_bytes()) for n in os.listdir(tmp_path / "new") if n != ".zarray"]
    batch = pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks]) for i in range(4)], ["f0", "f1", "f2", "payload"])

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    turn = itertools.count()
    steps = {"fsync": ("os.fsync", killed, old), "finish": ("finish", killed, new), "moves": ("_move", lambda x: killed() if next(turn) else os.replace(*x), new), "removals": ("_remove", killed, new)}
    for step, (name, replacement, want) in steps.items():
        path = str(tmp_path / step)
        g.write_array(spark, path, old, chunks=CHUNKS)
        writer = GridWriter({"path": path, "metadata": json.dumps(meta.document())}, overwrite)
        messages = [writer.write(iter([batch]))]
        with monkeypatch.context() as m:
            m.setattr(f"gridloom.sources.journal.{name}", replacement)
            if overwrite or step != "removals":
                with pytest.raises(Killed):
                    writer.commit(messages)
            else:
                writer.commit(messages)
        assert same(g.to_array(spark, path), want)
        assert not [n for n in os.listdir(path) if n.startswith(journal.PREFIX) and not n.endswith(".new")]
        assert step == "fsync" or len([n for n in os.listdir(path) if n[0] != "."]) == len(blocks)


def test_a_failing_task_clears_its_files(tmp_path):
    import pyarrow as pa

    from gridloom.meta import ArrayMeta
    from gridloom.sources.array_source import BLOCK_SCHEMA, GridWriter

    meta = ArrayMeta(shape=SHAPE, chunks=CHUNKS)
    writer = GridWriter({"path": str(tmp_path), "metadata": json.dumps(meta.document())}, True)

    def batches():
        yield pa.RecordBatch.from_arrays([*(pa.array([0], pa.int32()) for _ in range(3)), pa.array([b"x"])], [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])
        assert len(os.listdir(tmp_path)) == 1
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(batches())
    assert os.listdir(tmp_path) == []


def test_other_files_with_numbers_for_names_stay(spark, tmp_path):
    path = str(tmp_path / "a")
    g.write_array(spark, path, np.ones(SHAPE, "u2"), chunks=CHUNKS)
    os.makedirs(f"{path}/2024")
    for name in ("123", "2024/7"):
        with open(f"{path}/{name}", "w") as f:
            f.write("mine")
    g.write_array(spark, path, np.ones((4, 4, 4), "u2"), chunks=CHUNKS, dimension_separator="/")
    assert os.path.exists(f"{path}/123") and os.path.exists(f"{path}/2024/7") and os.path.exists(f"{path}/0/0/0") and not os.path.exists(f"{path}/0.0.0")


def test_cast_inherit_and_dtype_of_a_region(spark, tmp_path):
    path = str(tmp_path / "a")
    g.write_array(spark, path, np.ones(SHAPE, "u1"), chunks=CHUNKS, order="C", cname="gzip")
    g.write_array(spark, path, np.full((2, 2, 2), 300, "u2"), start=(0, 0, 0), end=(2, 2, 2), cast=True)
    assert g.to_array(spark, path)[0, 0, 0] == 44
    meta = g.write_array(spark, path, np.ones((5, 5, 5), "f4"), inherit=True)
    assert (meta.order, meta.cname, meta.chunks, meta.kind) == ("C", "gzip", CHUNKS, "f4")


def test_operators_over_voxels(spark, tmp_path):
    path = str(tmp_path / "a")
    data = rng.integers(0, 60000, (6, 5, 4)).astype("u2")
    g.write_array(spark, path, data, chunks=(4, 4, 4))
    rows = g.read_array(spark, path)
    swapped = g.read_array(spark, path, swap_axes=True).toPandas()
    assert (data[swapped.d1, swapped.d0, swapped.d2] == swapped.value).all()
    moved = regions.rebase(regions.region(rows, (1, 1, 1), (4, 4, 4)), (1, 1, 1)).toPandas()
    assert (data[1:4, 1:4, 1:4][moved.d0, moved.d1, moved.d2] == moved.value).all() and len(moved) == 27
    assert g.read_array(spark, path, (1, 1, 1), (4, 4, 4), rebase=True).agg({"d0": "max"}).first()[0] == 2
    empty = g.create_array(str(tmp_path / "e"), (0, 3, 3))
    assert empty.files[0] == 0 and g.read_array(spark, str(tmp_path / "e")).count() == 0
    named = regions.chunk_list(spark, g.open_array(path)).collect()
    assert {r.path for r in named} == {n for n in os.listdir(path) if n != ".zarray"}


def test_stream_into_an_array(spark, tmp_path):
    from gridloom.streaming.sink import merge_stream

    path, source = str(tmp_path / "a"), str(tmp_path / "in")
    g.create_array(path, (8, 4, 4), "<f8", chunks=(4, 4, 4))
    voxels = regions.box(spark, (0, 0, 0), (8, 4, 4)).selectExpr("d0", "d1", "d2", "cast(d0 * 100 + d1 * 10 + d2 as double) as value")
    voxels.write.parquet(source)
    query = merge_stream(spark.readStream.schema(voxels.schema).parquet(source), path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = g.to_array(spark, path)
    assert got[5, 3, 2] == 532 and got[7, 0, 0] == 700
