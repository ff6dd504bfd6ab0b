"""The metadata document of an array: its fields, its JSON and the rules for reading it."""

from __future__ import annotations

import json
import math
import os
import sys
import uuid
from dataclasses import dataclass, replace

import numpy as np

FILE = ".zarray"
#: Compressors that a block frame may hold, and the stream compressors.
BLOCK_CODECS = ("lz4", "lz4hc", "blosclz", "zlib", "zstd")
STREAM_CODECS = ("gzip", "zlib-stream")
#: Spark's type for each stored type; Spark has no unsigned ones.
SPARK_TYPES = {"u1": "smallint", "u2": "int", "f4": "float", "f8": "double"}


class MetadataError(ValueError):
    pass


def _triple(value, name: str) -> tuple[int, int, int]:
    try:
        out = tuple(int(v) for v in value)
    except (TypeError, ValueError) as e:
        raise MetadataError(f"metadataIncomplete: {name}") from e
    if len(out) != 3 or min(out) < 0:
        raise MetadataError(f"metadataIncomplete: {name} needs three lengths of at least 0")
    return out  # type: ignore[return-value]


@dataclass(frozen=True)
class ArrayMeta:
    """An array's layout. chunks is what one file holds; in sharded arrays files hold inner chunks of chunk_shape."""

    shape: tuple[int, int, int]
    chunks: tuple[int, int, int] = (256, 256, 256)
    dtype: str = "<u2"
    order: str = "F"
    cname: str = "lz4"
    clevel: int = 5
    dimension_separator: str = "."
    fill_value: int | float = 0
    subfolders: tuple[int, int, int] = (0, 0, 0)
    shard: bool = False
    chunk_shape: tuple[int, int, int] = (1, 1, 1)

    def __post_init__(self):
        for name in ("shape", "chunks", "subfolders", "chunk_shape"):
            object.__setattr__(self, name, _triple(getattr(self, name), name))
        order = self.order.upper()
        if order not in ("F", "C"):
            raise MetadataError(f"order must be F or C, not {self.order!r}")
        object.__setattr__(self, "order", order)
        if self.dtype[:1] not in "<>|" or self.dtype[1:] not in SPARK_TYPES:
            raise MetadataError(f"unsupported dtype {self.dtype!r}; there are {', '.join(SPARK_TYPES)}")
        if self.cname not in (*BLOCK_CODECS, *STREAM_CODECS):
            raise MetadataError(f"unsupportedCompressor: {self.cname}")
        if min(self.chunks) < 1:
            raise MetadataError("chunks need lengths of at least 1")
        if self.shard and (min(self.chunk_shape) < 1 or any(c % i for c, i in zip(self.chunks, self.chunk_shape, strict=True))):
            raise MetadataError(f"chunk_shape {self.chunk_shape} does not divide chunks {self.chunks}")
        if math.prod(self.chunks) * self.itemsize >= 1 << 31:
            raise MetadataError("a file's cells must take less than 2 GiB")

    # --- accessors ---

    @property
    def itemsize(self) -> int:
        return int(self.dtype[2])

    @property
    def kind(self) -> str:
        return self.dtype[1:]

    @property
    def numpy(self) -> np.dtype:
        return np.dtype(self.dtype.replace("|", "<"))

    @property
    def native(self) -> np.dtype:
        return self.numpy.newbyteorder("=")

    @property
    def opposite_endian(self) -> bool:
        return self.itemsize > 1 and (self.dtype[0] == ">") == (sys.byteorder == "little")

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.kind]

    @property
    def inner(self) -> tuple[int, int, int]:
        """Shape of what is compressed as one."""
        return self.chunk_shape if self.shard else self.chunks

    @property
    def chunks_per_shard(self) -> tuple[int, int, int]:
        return tuple(c // i for c, i in zip(self.chunks, self.inner, strict=True))  # type: ignore[return-value]

    @property
    def files(self) -> tuple[int, int, int]:
        """How many files there are along each axis."""
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunks, strict=True))  # type: ignore[return-value]

    @property
    def fill(self) -> np.ndarray:
        """The fill value as a cell; numbers out of range wrap in integer arrays, as in a C cast."""
        if self.kind[0] == "f":
            return np.array(self.fill_value, self.native)
        if isinstance(self.fill_value, float) and not math.isfinite(self.fill_value):
            raise MetadataError(f"an integer array cannot be filled with {self.fill_value}")
        return np.array(int(self.fill_value) % (1 << 8 * self.itemsize), self.native)

    def with_(self, **changes) -> ArrayMeta:
        return replace(self, **changes)

    # --- JSON ---

    @classmethod
    def parse(cls, document: dict) -> ArrayMeta:
        for key in ("chunks", "compressor", "dtype", "fill_value", "order", "shape", "zarr_format"):
            if key not in document:
                raise MetadataError(f"metadataIncomplete: {key}")
        if document.get("filters"):
            raise MetadataError("filters are not supported")
        codec = document["compressor"]
        if not isinstance(codec, dict):
            raise MetadataError("metadataIncomplete: compressor")
        if codec.get("id") == "blosc":
            cname, clevel = codec.get("cname"), codec.get("clevel")
        else:
            cname, clevel = {"zlib": "zlib-stream"}.get(codec.get("id"), codec.get("id")), codec.get("level")
        if cname is None or clevel is None:
            raise MetadataError("metadataIncomplete: compressor")
        codecs = document.get("codecs") or []
        shard = bool(codecs) and codecs[0].get("name") == "sharding_indexed"
        separator = document.get("dimension_separator")
        try:
            return cls(
                shape=document["shape"],
                chunks=document["chunks"],
                dtype=str(document["dtype"]),
                order=str(document["order"]),
                cname=str(cname),
                clevel=int(clevel),
                dimension_separator=separator if separator in (".", "/") else ".",
                fill_value=_fill(document["fill_value"], str(document["dtype"])),
                subfolders=document.get("subfolders") or (0, 0, 0),
                shard=shard,
                chunk_shape=codecs[0]["configuration"]["chunk_shape"] if shard else (1, 1, 1),
            )
        except (KeyError, TypeError) as e:
            raise MetadataError(f"metadataIncomplete: {e}") from e

    @classmethod
    def load(cls, path: str) -> ArrayMeta:
        name = os.path.join(os.path.expanduser(path), FILE)
        try:
            with open(name) as f:
                document = json.load(f)
        except FileNotFoundError:
            raise FileNotFoundError(f"metadataFileMissing:{name}") from None
        except ValueError as e:
            raise MetadataError(f"metadataIncomplete: {e}") from e
        return cls.parse(document)

    def document(self) -> dict:
        if self.cname in BLOCK_CODECS:
            compressor = {"blocksize": 0, "clevel": self.clevel, "cname": self.cname, "id": "blosc", "shuffle": 1}
        else:
            compressor = {"id": self.cname.removesuffix("-stream"), "level": self.clevel}
        fill = self.fill_value
        if isinstance(fill, float) and not math.isfinite(fill):
            fill = "NaN" if math.isnan(fill) else "Infinity" if fill > 0 else "-Infinity"
        out = {
            "chunks": list(self.chunks),
            "compressor": compressor,
            "dtype": self.dtype,
            "fill_value": fill,
            "filters": None,
            "order": self.order,
            "shape": list(self.shape),
            "zarr_format": 2,
        }
        if self.dimension_separator == "/":
            out["dimension_separator"] = "/"
        if any(self.subfolders):
            out["subfolders"] = list(self.subfolders)
        if self.shard:
            inner = [{"name": "bytes", "configuration": {"endian": "little"}}]
            index = [*inner, {"name": "crc32c"}]
            out["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(self.chunk_shape), "codecs": inner, "index_codecs": index, "index_location": "end"}}]
        return out

    def save(self, path: str) -> None:
        """Write the document under a temporary name and rename it, so that readers see all or nothing."""
        path = os.path.expanduser(path)
        os.makedirs(path, exist_ok=True)
        temporary = os.path.join(path, FILE + uuid.uuid4().hex)
        try:
            with open(temporary, "w") as f:
                json.dump(self.document(), f, indent=4)
        except OSError as e:
            raise OSError(f"cannotOpenZarray:{temporary}") from e
        os.replace(temporary, os.path.join(path, FILE))


def _fill(value, dtype: str) -> int | float:
    """The fill value by the array's type: real numbers in float arrays, whole ones in integer arrays."""
    is_float = dtype[1:2] == "f"
    if value is None or value == "null":
        return 0
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError as e:
            raise MetadataError(f"metadataIncomplete: fill_value {value!r}") from e
        if not is_float:
            if math.isnan(value):
                return 0
            if math.isinf(value):
                raise MetadataError("an integer array cannot be filled with an infinity")
    if is_float:
        return float(value)
    return int(value)
