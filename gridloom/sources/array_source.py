"""The Spark data source "gridloom": arrays as voxel or chunk rows, and a sink of finished block files.

Reading takes the options path; start and end (half-open, from 0) or bbox (from 1, inclusive); view
(voxels or chunks); sparse; rebase; partition_bytes. A region is cut down to the chunks that it touches
before any file is opened; with spark.sql.python.filterPushdown.enabled and the option pushdown, range
predicates on d0, d1 and d2 prune chunks as well.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom import grid
from gridloom.meta import ArrayMeta
from gridloom.sources import files, journal

NAME = "gridloom"
#: Decoded bytes of a partition, about, and rows of an Arrow batch.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 1 << 18
CHUNK_VIEW = "c0 int, c1 int, c2 int, shard string, payload binary"
BLOCK_SCHEMA = "f0 int, f1 int, f2 int, payload binary"
_arrow = {"u1": pa.int16(), "u2": pa.int32(), "f4": pa.float32(), "f8": pa.float64()}


def voxel_schema(meta: ArrayMeta) -> str:
    return f"d0 bigint, d1 bigint, d2 bigint, value {meta.spark_type}"


def _numbers(text: str | None) -> list[int] | None:
    return None if text is None or not text.strip() else [int(v) for v in text.replace("[", " ").replace("]", " ").replace(",", " ").split()]


@dataclass
class Files(InputPartition):
    """Files first to last (not included) of a box of files, by their number in it."""

    first: int
    last: int


class GridReader(DataSourceReader):
    def __init__(self, meta: ArrayMeta, options: dict):
        self.meta, self.root = meta, os.path.expanduser(options["path"])
        start, end, bbox = (_numbers(options.get(k)) for k in ("start", "end", "bbox"))
        if bbox:
            start, end = grid.bbox_to_region(bbox)
        self.start, self.end = grid.region(meta.shape, start, end)
        self.chunks = options.get("view", "voxels") == "chunks"
        self.sparse = str(options.get("sparse", "false")).lower() == "true"
        self.rebase = str(options.get("rebase", "false")).lower() == "true"
        self.shift = self.start if self.rebase else (0, 0, 0)
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.cores = int(options.get("min_partitions", 1))

    @property
    def box(self) -> tuple[grid.Triple, grid.Triple]:
        return grid.touched(self.start, self.end, self.meta.chunks)

    def partitions(self) -> list[Files]:
        n = prod(grid.extent(*self.box)) if all(b > a for a, b in zip(self.start, self.end, strict=True)) else 0
        if not n:
            return [Files(0, 0)]
        parts = min(n, max(self.cores, -(-n * prod(self.meta.chunks) * self.meta.itemsize // self.bytes)))
        return [Files(n * i // parts, n * (i + 1) // parts) for i in range(parts)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        meta, (low, high) = self.meta, self.box
        inner = grid.touched(self.start, self.end, meta.inner)
        for i in range(partition.first, partition.last):
            file = grid.at(i, low, high)
            for chunk, data in files.inner_chunks(meta, self.root, file, *inner):
                if self.chunks:
                    if data is not None:
                        shard = grid.name(file, meta.dimension_separator) if meta.shard else None
                        yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.int32()) for c in chunk), pa.array([shard], pa.string()), pa.array([data], pa.binary())], ["c0", "c1", "c2", "shard", "payload"])
                elif self._inside(chunk):
                    yield from self._voxels(chunk, data)

    def _inside(self, chunk: grid.Triple) -> bool:
        return all(c * k < e and (c + 1) * k > s for c, k, s, e in zip(chunk, self.meta.inner, self.start, self.end, strict=True))

    def _voxels(self, chunk: grid.Triple, data: bytes | None) -> Iterator[pa.RecordBatch]:
        meta = self.meta
        base = [c * k for c, k in zip(chunk, meta.inner, strict=True)]
        a = [max(s, b) for s, b in zip(self.start, base, strict=True)]
        z = [min(e, b + k) for e, b, k in zip(self.end, base, meta.inner, strict=True)]
        if data is None or self.sparse and not any(data):
            block = np.broadcast_to(meta.fill, [y - x for x, y in zip(a, z, strict=True)])
        else:
            block = files.cells(meta, data)[tuple(slice(x - b, y - b) for x, y, b in zip(a, z, base, strict=True))]
        shift = self.shift
        rows = max(1, BATCH_ROWS // max(1, (z[1] - a[1]) * (z[2] - a[2])))
        for x in range(a[0], z[0], rows):
            part = block[x - a[0] : x - a[0] + rows]
            axes = [np.arange(n, dtype=np.int64) + o for n, o in zip(part.shape, (x - shift[0], a[1] - shift[1], a[2] - shift[2]), strict=True)]
            d0, d1, d2 = (g.reshape(-1) for g in np.meshgrid(*axes, indexing="ij"))
            values = np.ascontiguousarray(part).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(d0), pa.array(d1), pa.array(d2), pa.array(values).cast(_arrow[meta.kind])], ["d0", "d1", "d2", "value"])


class PushingReader(GridReader):
    """Narrows its region by range predicates on coordinates; Spark applies them again after the scan."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        start, end = list(self.start), list(self.end)
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in ("d0", "d1", "d2") and isinstance(f.value, int):
                axis = int(f.attribute[0][1])
                value = f.value + self.shift[axis]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    start[axis] = max(start[axis], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end[axis] = min(end[axis], value + (not isinstance(f, LessThan)))
            yield f
        self.start, self.end = tuple(start), tuple(max(a, b) for a, b in zip(start, end, strict=True))


@dataclass
class Written(WriterCommitMessage):
    """Temporary files of a task with their places, and places that are to be empty."""

    moves: list[tuple[str, str]]
    gone: list[str]


class GridWriter(DataSourceArrowWriter):
    """Publishes block files: tasks write temporary files, the driver renames them by one journal or deletes them all."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = os.path.expanduser(options["path"]), overwrite
        self.meta = ArrayMeta.parse(json.loads(options["metadata"])) if "metadata" in options else journal.opened(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        moves, gone = [], []
        try:
            for batch in iterator:
                for f0, f1, f2, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    place = grid.path(self.meta, self.root, (f0, f1, f2))
                    if payload is None:
                        gone.append(place)
                    else:
                        moves.append((files.write_temporary(self.meta, self.root, (f0, f1, f2), payload), place))
        except BaseException:  # Spark aborts with the messages of finished tasks alone
            self._clear(moves)
            raise
        return Written(moves, gone)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        moves, gone = [x for m in done for x in m.moves], [x for m in done for x in m.gone]
        places = [p for _, p in moves] + gone
        if len(set(places)) != len(places):
            self.abort(messages)
            raise RuntimeError("two tasks wrote one block")
        if self.overwrite:
            journal.recover(self.root)
            keep = {name for move in moves for name in move}
            gone = [name for name in files.present(self.root) if name not in keep]
        journal.publish(self.root, self.meta if self.overwrite else None, moves, gone)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            self._clear(m.moves if m is not None else [])

    @staticmethod
    def _clear(moves: list[tuple[str, str]]) -> None:
        for temporary, _ in moves:
            if os.path.exists(temporary):
                os.remove(temporary)


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        meta = journal.opened(self.options["path"])
        return CHUNK_VIEW if self.options.get("view", "voxels") == "chunks" else voxel_schema(meta)

    def reader(self, schema: StructType) -> DataSourceReader:
        meta = journal.opened(self.options["path"])
        pushes = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingReader if pushes else GridReader)(meta, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GridWriter(dict(self.options), overwrite)
