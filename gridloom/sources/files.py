"""Reading and writing the files of an array: one block of meta.chunks cells each."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from math import prod

import numpy as np

from gridloom import codecs, grid
from gridloom.meta import ArrayMeta


def cells(meta: ArrayMeta, data: bytes) -> np.ndarray:
    """An inner chunk's bytes as an array indexed [d0, d1, d2], in native byte order."""
    return np.frombuffer(data, meta.numpy).reshape(meta.inner, order=meta.order).astype(meta.native, copy=False)


def packed(meta: ArrayMeta, block: np.ndarray) -> bytes:
    """The bytes of an inner chunk in the array's order and byte order."""
    return block.astype(meta.numpy, copy=False).tobytes(order=meta.order)


def _same(block: np.ndarray, fill: np.ndarray) -> bool:
    """Whether every cell has the fill value's bits."""
    bits = f"u{block.itemsize}"
    return bool((np.ascontiguousarray(block).view(bits) == fill.view(bits)).all())


def encode_file(meta: ArrayMeta, block: np.ndarray, sparse: bool = True) -> bytes | None:
    """A file's bytes for a block of meta.chunks cells; None where it is all fill and may be left out."""
    if not meta.shard:
        if sparse and _same(block, meta.fill):
            return None
        return codecs.encode(packed(meta, block), meta.cname, meta.clevel, meta.itemsize)
    inner: list[bytes | None] = []
    for place in range(prod(meta.chunks_per_shard)):
        low = [a * k for a, k in zip(grid.at(place, (0, 0, 0), meta.chunks_per_shard), meta.inner, strict=True)]
        part = block[tuple(slice(a, a + k) for a, k in zip(low, meta.inner, strict=True))]
        inner.append(None if sparse and _same(part, meta.fill) else codecs.encode(packed(meta, part), meta.cname, meta.clevel, meta.itemsize))
    return None if all(c is None for c in inner) else codecs.join_shard(inner)


def inner_chunks(meta: ArrayMeta, root: str, file: grid.Triple, low: grid.Triple, high: grid.Triple):
    """(chunk, bytes) of the inner chunks of a file that lie in a box of chunks; bytes are None where missing."""
    name = grid.path(meta, root, file)
    size = prod(meta.inner) * meta.itemsize
    if not meta.shard:
        try:
            with open(name, "rb") as f:
                yield file, codecs.decode(f.read(), meta.cname, size)
        except FileNotFoundError:
            yield file, None
        except codecs.CodecError as e:
            raise codecs.CodecError(f"Decompression error: {e}. ChunkName: {name}") from e
        return
    per = meta.chunks_per_shard
    first = tuple(max(a, f * p) for a, f, p in zip(low, file, per, strict=True))
    last = tuple(min(b, (f + 1) * p) for b, f, p in zip(high, file, per, strict=True))
    try:
        with open(name, "rb") as f:
            footer = 16 * prod(per) + 4
            f.seek(-min(footer, os.fstat(f.fileno()).st_size), os.SEEK_END)
            index = codecs.shard_index(f.read(), prod(per))
            for chunk in grid.blocks(first, last):
                entry = index[grid.place_in_shard(chunk, per)]
                if entry is None:
                    yield chunk, None
                    continue
                f.seek(entry[0])
                yield chunk, codecs.decode(f.read(entry[1]), meta.cname, size)
    except FileNotFoundError:
        for chunk in grid.blocks(first, last):
            yield chunk, None
    except codecs.CodecError as e:
        raise codecs.CodecError(f"Decompression error: {e}. ChunkName: {name}") from e


def read_file(meta: ArrayMeta, root: str, file: grid.Triple) -> np.ndarray:
    """All cells of a file, fill where chunks are missing."""
    out = np.full(meta.chunks, meta.fill)
    per = meta.chunks_per_shard
    low = tuple(f * p for f, p in zip(file, per, strict=True))
    high = tuple((f + 1) * p for f, p in zip(file, per, strict=True))
    for chunk, data in inner_chunks(meta, root, file, low, high):
        if data is not None:
            at = tuple(slice((c % p) * k, (c % p + 1) * k) for c, p, k in zip(chunk, per, meta.inner, strict=True))
            out[at] = cells(meta, data)
    return out


def write_temporary(meta: ArrayMeta, root: str, file: grid.Triple, data: bytes) -> str:
    """Write a file under a name of its own beside its place, and say which."""
    name = grid.path(meta, root, file)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    try:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(temporary, "wb") as f:
            f.write(data)
    except OSError as e:
        raise OSError(f"Check permissions or filepath. Cannot write to path: {name}") from e
    return temporary


_block_file = re.compile(r"(\d+_\d+_\d+/)?(\d+\.\d+\.\d+|\d+/\d+/\d+)(\.[0-9a-f]{32}\.tmp)?")


def present(root: str) -> Iterator[str]:
    """Paths of all block files below a folder, of whatever layout, and of temporary ones left behind."""
    for folder, _, names in os.walk(root):
        for n in names:
            name = os.path.join(folder, n)
            if _block_file.fullmatch(os.path.relpath(name, root).replace(os.sep, "/")):
                yield name
