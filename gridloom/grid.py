"""Chunk arithmetic: which files and chunks a region touches, their names, folders and places in shards."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from math import prod

from gridloom.meta import ArrayMeta

Triple = tuple[int, int, int]


def region(shape: Triple, start: Iterable[int] | None = None, end: Iterable[int] | None = None) -> tuple[Triple, Triple]:
    """The half-open box [start, end) within shape; no start is the origin, no end or [0, 0, 0] is the shape."""
    first = tuple(int(v) for v in start) if start is not None else (0, 0, 0)
    last = tuple(int(v) for v in end) if end is not None else (0, 0, 0)
    if len(first) != 3 or len(last) != 3:
        raise ValueError("a region needs three coordinates each way")
    if not any(last):
        last = tuple(shape)
    if min(first) < 0 or any(b <= a for a, b in zip(first, last, strict=True)) and all(shape):
        raise ValueError("Invalid start_coords or end_coords!")
    if any(b > n for b, n in zip(last, shape, strict=True)):
        raise ValueError(f"Upper bound is invalid: {last} is beyond the shape {tuple(shape)}")
    return first, last  # type: ignore[return-value]


def bbox_to_region(bbox: Iterable[int]) -> tuple[Triple, Triple]:
    """[x0 y0 z0 x1 y1 z1], from 1 and inclusive, as a half-open box from 0."""
    box = [int(v) for v in bbox]
    if len(box) != 6:
        raise ValueError("bbox needs six numbers")
    start, end = (box[0] - 1, box[1] - 1, box[2] - 1), (box[3], box[4], box[5])
    if min(start) < 0 or any(b <= a for a, b in zip(start, end, strict=True)):
        raise ValueError("Lower bound is invalid")
    return start, end


def touched(start: Triple, end: Triple, size: Triple) -> tuple[Triple, Triple]:
    """The half-open box of cells' blocks of a size that a region touches."""
    return tuple(s // k for s, k in zip(start, size, strict=True)), tuple(-(-e // k) for e, k in zip(end, size, strict=True))  # type: ignore[return-value]


def extent(low: Triple, high: Triple) -> Triple:
    return tuple(max(0, b - a) for a, b in zip(low, high, strict=True))  # type: ignore[return-value]


def at(index: int, low: Triple, high: Triple) -> Triple:
    """The index-th block of a box, the first axis slowest."""
    _, n1, n2 = extent(low, high)
    return low[0] + index // (n1 * n2), low[1] + index // n2 % n1, low[2] + index % n2


def blocks(low: Triple, high: Triple) -> Iterator[Triple]:
    for i in range(prod(extent(low, high))):
        yield at(i, low, high)


def name(block: Triple, separator: str = ".") -> str:
    return separator.join(map(str, block))


def parse_name(text: str) -> Triple:
    """Coordinates from a name, whatever single character separates them."""
    digits = "".join(c if c.isdigit() else " " for c in text).split()
    if len(digits) != 3:
        raise ValueError(f"not a chunk name: {text!r}")
    return int(digits[0]), int(digits[1]), int(digits[2])


def subfolder(block: Triple, subfolders: Triple) -> str:
    if not any(subfolders):
        return ""
    return "_".join(str(b // f if f else 0) for b, f in zip(block, subfolders, strict=True))


def path(meta: ArrayMeta, root: str, block: Triple) -> str:
    """The file of a block of meta.chunks cells."""
    return os.path.join(root, subfolder(block, meta.subfolders), name(block, meta.dimension_separator))


def shard_of(chunk: Triple, per_shard: Triple) -> Triple:
    return tuple(c // p for c, p in zip(chunk, per_shard, strict=True))  # type: ignore[return-value]


def place_in_shard(chunk: Triple, per_shard: Triple) -> int:
    """Number of an inner chunk in its shard, the last axis fastest."""
    a, b, c = (x % p for x, p in zip(chunk, per_shard, strict=True))
    return (a * per_shard[1] + b) * per_shard[2] + c


def linear(block: Triple, counts: Triple) -> int:
    """Number of a block among all, the last axis fastest."""
    return (block[0] * counts[1] + block[1]) * counts[2] + block[2]


def covers(start: Triple, end: Triple, block: Triple, size: Triple, shape: Triple) -> bool:
    """Whether a region holds all of a block's cells that lie within the shape."""
    return all(s <= b * k and min((b + 1) * k, n) <= e for s, e, b, k, n in zip(start, end, block, size, shape, strict=True))
