"""Substring dedup: compact windows find passages that repeat, near copies included, across documents.

A document is the sequence of its five-word shingles. Two passages of at least min_words words are near copies
where the Jaccard similarity of their shingles is 0.8 or more; both begin and end with shingles of the other.
So a passage lies in a region whose shingles occur elsewhere but for a fifth; what no region holds is left out.
Equal regions are one from then on, each joined to the first with the same shingles.

For each of HASHES hash functions a Cartesian tree over a region's values (its root the least, its subtrees the
ranges left and right of it) gives compact windows (l, c, r): every subsequence within l..r that holds c has c's
value as its min-hash. Regions that share a value are joined to the first of them, in the map task and then
over all tasks, so that a passage which a third of all documents hold costs a row for each document and no pair
beyond. Aligned windows of all hash functions meet in an interval join; regions that enough functions join are
compared on their shingles.

The first region of a value may hold less than the passage, and hash functions may miss it. So an exact check
follows: in one order of all shingles, rarest first, the first shingle that two near copies have in common has at
most a fifth of either before it, and the next few little more. Regions that hold IN_COMMON shingles in such
places are compared, all pairs of them, but for shingles around which both have passages of one class: passages
joined by links already found, so these two are joined through others. A large class is found in a few rounds
before that, in which the others meet one of its members at a time. At last, exact stretches of min_words words
that no passage found so far covers are joined to the first document that has the same.

Defined cases: null, empty and short texts hold no passage; rows whose doc_id is null are left out; rows
that share a doc_id are documents of one id, whose passages in common are not reported; a passage that
repeats within one document alone is not reported.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.ngram_join import FILTER_EACH, FILTER_MOST

WIDTH, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many must agree on a candidate. Where 0.8 of the shingles agree, so do 2 of 4 with probability 0.97.
HASHES, ENOUGH = 4, 2
#: Windows that a map task joins among themselves at a time, and shingles that it counts at a time.
AT_ONCE, COUNT_AT_ONCE = 1 << 20, 4 << 20
#: A shingle counts as shared, and comes later in the order of all shingles, where it occurs so often.
LEVELS = (2, 16, 128)
#: A stretch may hold one shingle that its copy lacks for so many that the copy has.
PER_LOSS = round(SIMILARITY / (1 - SIMILARITY))
#: Shares of a region's shingles at which its order is cut to find its prefix; a coarser cut only makes the prefix longer.
CUTS = (0, 0.04, 0.08, 0.12, 0.16, 0.2, 0.24, 0.28, 0.33, 0.4, 0.5, 0.65, 0.8)
#: Different shingles that two regions must have in common in their prefixes, unless copies consist of one; so often one may occur among few.
IN_COMMON, REPEATED = 2, 6
#: Rounds in which regions under other labels meet one of the commonest label alone.
ROUNDS = 2
#: Pairs, regions or shingles that a task holds at a time.
PAIRS_AT_ONCE, REGIONS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 20, 1 << 17, 1 << 16
ENTRY = np.dtype([("value", "<u8"), ("region", "<i8"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4")])
HOLDER = np.dtype([("token", "<u8"), ("region", "<i8"), ("label", "<i8"), ("weight", "u1")])
EDGE = ("member", "center", "k", "lc", "cc", "rc", "lm", "cm", "rm")
EDGE_SCHEMA = "member long, center long, k int, lc int, cc int, rc int, lm int, cm int, rm int"
REGION = ["region", "key", "doc", "low", "shingles"]
PLACES, PLACES_SCHEMA = ["region", "n", "at", "tokens", "weights"], "region long, n int, at binary, tokens binary, weights binary"
FOUND = ["doc_id", "start_word", "n_words", "other_id", "other_start", "other_words", "similarity"]
FOUND_SCHEMA = "doc_id long, start_word int, n_words int, other_id long, other_start int, other_words int, similarity double"
REGION_SCHEMA = f"region long, key long, doc long, low int, shingles binary, {FOUND_SCHEMA}"
LINK = ["member", "center", "m_low", "m_high", "c_low", "c_high", *FOUND]
LINK_SCHEMA = f"member long, center long, m_low int, m_high int, c_low int, c_high int, {FOUND_SCHEMA}"
SIDES = (("member", "m_low", "m_high"), ("center", "c_low", "c_high"))
SAME = np.dtype([("value", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("open", "?")])
PAIR_SCHEMA = "member long, center long, weight long"
_SEEDS = common.numbers(HASHES, 41)
_FOUND_KINDS = (*(pa.int64(), pa.int32(), pa.int32()) * 2, pa.float64())


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The windows (l, c, r) of at least so many values, from the tree's root down."""
    out, open_ranges = [], [(0, len(values))]
    while open_ranges:
        a, b = open_ranges.pop()
        if b - a >= least:
            c = a + int(values[a:b].argmin())
            out.append((a, c, b - 1))
            open_ranges += [(a, c), (c + 1, b)]
    return out


def _joined(entries: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first entry of each value, and the edges from it to the other regions' entries of the value."""
    order = np.lexsort((entries["c"], entries["region"], entries["value"]))
    entries = entries[order]
    fresh = np.ones(len(entries), bool)
    fresh[1:] = entries["value"][1:] != entries["value"][:-1]
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(entries) else np.zeros(0, np.int64)
    others = entries["region"] != entries["region"][first]
    member, center = entries[others], entries[first[others]]
    edges = [member["region"], center["region"], (member["value"] % np.uint64(HASHES)).astype(np.int32), *(center[n] for n in "lcr"), *(member[n] for n in "lcr")]
    return entries[fresh], edges


def _edge_batches(edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(edges[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(edges[0][a : a + (1 << 16)]), pa.int32()), pa.nulls(len(edges[0][a : a + (1 << 16)]), pa.binary()), *(pa.array(np.ascontiguousarray(e[a : a + (1 << 16)])) for e in edges)], ["part", "blob", *EDGE])


def _flushed(held: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """First entries of each value as blobs by part of the values, and the edges among these entries."""
    entries, edges = _joined(np.concatenate([np.zeros(0, ENTRY), *held]))
    yield from _edge_batches(edges)
    part = (entries["value"] // np.uint64(HASHES) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    entries, part = entries[order], part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    blobs = [entries[cuts[i] : cuts[i + 1]].tobytes() for i in full]
    nothing = [pa.nulls(len(full), pa.int64())] * 2 + [pa.nulls(len(full), pa.int32())] * 7
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), *nothing], ["part", "blob", *EDGE])


def _dealt(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order of the tokens by part, the parts that have some, and where these begin."""
    part = (tokens % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    return order, full.astype(np.int32), [*cuts[full].tolist(), len(tokens)]


def _counts(parts: int, least: int):
    """Shingles of documents that can hold a passage, as blobs by part: 32 bits, and how often here (255 at most)."""

    def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        seen = np.minimum(np.diff(np.append(first, len(tokens))), 255).astype(np.uint8)
        tokens = tokens[first]
        order, full, cuts = _dealt(tokens, parts)
        high, seen = (tokens >> np.uint64(32)).astype(np.uint32)[order], seen[order]
        blobs = [high[a:b].tobytes() + seen[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(full), pa.array(blobs[: len(full)], pa.binary())], ["part", "blob"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in common.chunks(batch.column("text")):
                hashes, bounds = common.shingles(chunk, WIDTH)
                n = np.diff(bounds)
                held.append(hashes[np.repeat(n >= least, n)])
                size += len(held[-1])
                if size >= COUNT_AT_ONCE:
                    yield flushed(held)
                    held, size = [], 0
        yield flushed(held)

    return rows


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of shingles that reach each level, and how many there are."""
    held = []
    for batch in batches:
        for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(blob) // 5
            high, seen = np.frombuffer(blob, np.uint32, n).astype(np.uint64), np.frombuffer(blob, np.uint8, n, 4 * n)
            held.append(np.uint64(part) << np.uint64(40) | high << np.uint64(8) | seen)
    both = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
    del held
    keys = both >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    seen = np.add.reduceat((both & np.uint64(255)).astype(np.int64), first) if len(first) else first
    keys = keys[first]
    for level, some in enumerate(LEVELS):
        own = keys[seen >= some]
        for a in range(0, len(own), 1 << 17):
            blob = own[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([len(blob)], pa.int64()), pa.array([blob.tobytes()], pa.binary())], ["level", "n", "blob"])


def _filters(often: DataFrame, levels: int = len(LEVELS)) -> list[np.ndarray]:
    """For each level a one-hash Bloom filter of its keys, of FILTER_MOST bits at most; a full filter only lets more pass."""
    sizes = {r[0]: r[1] for r in often.groupBy("level").agg(F.sum("n")).collect()}
    bits = [min(FILTER_MOST, 64 << int(np.ceil(np.log2(max(1, sizes.get(i, 0) * FILTER_EACH / 64))))) for i in range(levels)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, blob in zip(batch.column("level").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                at = np.sort(common.mix(np.frombuffer(blob, np.uint64)) % np.uint64(bits[level]))
                word, first = np.unique(at // np.uint64(64), return_index=True)
                own = np.bitwise_or.reduceat(np.uint64(1) << at % np.uint64(64), first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), level, np.int32)), pa.array(word.astype(np.int64)), pa.array(own.view(np.int64))], ["level", "word", "bits"])

    words = often.mapInArrow(rows, "level int, word long, bits long").groupBy("level", "word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    level, word, own = (words.column(i).to_numpy() for i in range(3))
    out = []
    for i, n in enumerate(bits):
        out.append(np.zeros(n // 64, np.int64))
        out[-1][word[level == i]] = own[level == i]
    return [x.view(np.uint64) for x in out]


def _passes(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    return common.mix((hashes % np.uint64(parts)) << np.uint64(32) | hashes >> np.uint64(32))


def covered(held: np.ndarray, row: np.ndarray, least: int, more: int = 0) -> np.ndarray:
    """What lies in a stretch of so many within one row (row: ascending) that are held but for a fifth, and some more."""
    return _covered(np.where(held, 1, -PER_LOSS), row, least, (PER_LOSS + 1) * more)


def _covered(gains: np.ndarray, row: np.ndarray, least: int, slack: int) -> np.ndarray:
    """What lies in a stretch of so many within one row whose gains sum up to -slack or more."""
    at = np.arange(len(gains)) + row + 1  # before each row something that no stretch makes up for
    size = at[-1] + 1 if len(at) else 0
    before = np.full(size + 1, -len(gains) - slack - 1)
    before[0] = 0
    before[at + 1] = gains
    np.cumsum(before, out=before)
    best = np.maximum.accumulate(before[::-1])[::-1]
    last = np.searchsorted(-best, slack - before, "right") - 1
    from_ = np.flatnonzero(last - np.arange(size + 1) >= least)
    steps = np.bincount(from_, minlength=size + 1) - np.bincount(last[from_], minlength=size + 1)
    return np.cumsum(steps)[at] > 0


def _spans(held: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges [a, b] of true values."""
    ends = np.flatnonzero(np.diff(held.astype(np.int8), prepend=0, append=0))
    return zip(ends[::2].tolist(), (ends[1::2] - 1).tolist(), strict=True)


def dense(held: np.ndarray, row: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b] of what is covered, without what is not held at their ends, where so many are left."""
    within = covered(held, row, least)
    number = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (within[1:] != within[:-1])])) if len(held) else row
    at = np.flatnonzero(within & held)
    first = np.flatnonzero(np.concatenate([[True], number[at][1:] != number[at][:-1]])) if len(at) else at
    last = np.append(first[1:], len(at))[: len(first)] - 1
    for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True):
        if b - a + 1 >= least:
            yield a, b


def _found(out: list[tuple]) -> list[pa.Array]:
    return [pa.array([o[i] for o in out], t) for i, t in enumerate(_FOUND_KINDS)]


def _region_rows(regions: list[tuple], out: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (region, key, doc, low, shingles), and rows for links between copies."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in regions], t) for i, t in enumerate(kinds)), *(pa.nulls(len(regions), t) for t in _FOUND_KINDS)], [*REGION, *FOUND])
    both = [x for a, b, n in out for x in ((*a, n, *b, n, 1.0), (*b, n, *a, n, 1.0))]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(both), t) for t in kinds), *_found(both)], [*REGION, *FOUND])


def _number(own: bytes) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(own)], np.uint64).view(np.int64)[0])


def _regions(filters: Broadcast, parts: int, least: int):
    """The regions of each document, equal ones of this task joined to the first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, known, regions, out, size = filters.value[0], {}, [], [], 0
        for batch in batches:
            docs, at = batch.column("doc_id").to_numpy(), 0
            for chunk in common.chunks(batch.column("text")):
                hashes, bounds = common.shingles(chunk, WIDTH)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                held = _passes(_keys(hashes, parts), shared)
                own = (np.bincount(row, held, len(n)) * (PER_LOSS + 1) >= least * PER_LOSS)[row]
                where = np.flatnonzero(own)
                for a, b in dense(held[own], row[own], least):
                    a, b = int(where[a]), int(where[b])
                    doc, low, piece = int(docs[at + row[a]]), a - int(bounds[row[a]]), hashes[a : b + 1].tobytes()
                    key = _number(piece)
                    first = known.setdefault(key, (doc, low))
                    if first[0] != doc:
                        out.append(((doc, low), first, b - a + WIDTH))
                    else:
                        regions.append((None, key, doc, low, piece))
                        size += b - a + 1
                at += chunk.n
                if size >= SHINGLES_AT_ONCE or len(out) >= SHINGLES_AT_ONCE:
                    yield from _region_rows(regions, out)
                    regions, out, size = [], [], 0
                if len(known) >= REGIONS_AT_ONCE:
                    known = {}
        yield from _region_rows(regions, out)

    return rows


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal regions; the others joined to it, or to the next where they are of its document."""
    regions, out, size = [], [], 0
    for table in common.runs(batches, "key"):
        places = list(zip(table.column("doc").to_pylist(), table.column("low").to_pylist(), strict=True))
        piece = table.column("shingles")[0].as_py()
        first, other = places[0], next((p for p in places if p[0] != places[0][0]), None)
        for i, place in enumerate(places):
            if i and (to := first if place[0] != first[0] else other):
                out.append((place, to, len(piece) // 8 + WIDTH - 1))
            elif not i or place != first:
                regions.append((_number(piece + np.array(place, np.int64).tobytes()), table.column("key")[0].as_py(), *place, piece))
                size += len(piece) // 8
        if size >= SHINGLES_AT_ONCE or len(out) >= SHINGLES_AT_ONCE:
            yield from _region_rows(regions, out)
            regions, out, size = [], [], 0
    yield from _region_rows(regions, out)


def _windows(parts: int, least: int):
    """First windows of each value as blobs by part of the values, and the edges within this task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for region, piece in zip(batch.column("region").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                hashes = np.frombuffer(piece, np.uint64)
                for k, seed in enumerate(_SEEDS):
                    several = common.mix(hashes ^ seed)
                    own = np.array(compact_windows(several, least), np.int32)
                    _, widest = np.unique(several[own[:, 1]], return_index=True)  # parents come before their subtrees
                    own = own[widest]
                    both = np.zeros(len(own), ENTRY)
                    both["value"] = several[own[:, 1]] // np.uint64(HASHES) * np.uint64(HASHES) + np.uint64(k)
                    both["region"], both["l"], both["c"], both["r"] = region, own[:, 0], own[:, 1], own[:, 2]
                    held.append(both)
                    size += len(both)
                if size >= AT_ONCE:
                    yield from _flushed(held, parts)
                    held, size = [], 0
        yield from _flushed(held, parts)

    return rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the first windows of all tasks; the tasks' own edges pass through."""
    blobs = []
    for batch in batches:
        blobs += batch.column("blob").filter(batch.column("blob").is_valid()).to_pylist()
        rest = batch.filter(batch.column("member").is_valid())
        yield rest.select(list(EDGE))
    _, edges = _joined(np.frombuffer(b"".join(blobs), ENTRY))
    for batch in _edge_batches(edges):
        yield batch.select(list(EDGE))


def stretches(k: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Interval join: maximal stretches [a, b] under intervals of ENOUGH hash functions or more."""
    events = []
    for h in range(HASHES):
        own = np.flatnonzero(k == h)
        own = own[np.argsort(low[own], kind="stable")]
        a = b = None
        for x, y in zip(low[own].tolist(), high[own].tolist(), strict=True):
            if b is not None and x <= b + 1:
                b = max(b, y)
            else:
                if b is not None:
                    events += [(a, 1), (b + 1, -1)]
                a, b = x, y
        if b is not None:
            events += [(a, 1), (b + 1, -1)]
    out, depth, since = [], 0, 0
    for at, step in sorted(events, key=lambda e: (e[0], -e[1])):
        if depth < ENOUGH <= depth + step:
            since = at
        if depth + step < ENOUGH <= depth and at - since >= least:
            out.append((since, at - 1))
        depth += step
    return out


def _candidates(least: int):
    """Regions that may hold near copies: aligned windows of enough functions have a stretch in common."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table in common.runs(batches, "member"):
            member = table.column("member")[0].as_py()
            center, k, lc, cc, rc, lm, cm, rm = (table.column(n).to_numpy() for n in EDGE[1:])
            low, high = np.maximum(lc, lm - cm + cc), np.minimum(rc, rm - cm + cc)
            cuts = [0, *(np.flatnonzero(center[1:] != center[:-1]) + 1).tolist(), len(center)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = a + np.flatnonzero(high[a:b] - low[a:b] + 1 >= least)
                if len(own) >= ENOUGH and stretches(k[own], low[own], high[own], least):
                    out.append((member, int(center[a])))
            if len(out) >= 1 << 14:
                yield made(out)
                out = []
        yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["member", "center"])

    return rows


def indexed(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles, for each place the number of its shingle, and the place before that has the same (or -1)."""
    by = np.argsort(shingles, kind="stable")
    values = shingles[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = values[1:] != values[:-1]
    code, before = np.zeros(len(by), np.int32), np.full(len(by), -1, np.int32)
    code[by] = np.cumsum(fresh) - 1
    again = np.flatnonzero(~fresh)
    before[by[again]] = by[again - 1]
    return values[fresh], code, before


def fewest(before: np.ndarray, least: int) -> int:
    """How many different shingles every stretch of so many holds at least."""
    at = np.arange(len(before))
    since = np.maximum(before, at - least) + 1  # stretches that begin from here to the place have it as the first of its kind
    steps = np.bincount(since, minlength=len(before) + 1) - (np.arange(len(before) + 1) > 0)
    return int(np.cumsum(steps)[: len(before) - least + 1].min(initial=least))


def matches(center: np.ndarray, member: np.ndarray, least: int) -> list[tuple[int, int, int, int, float]]:
    """(start, size) in center, (start, size) in member, similarity of the runs that are near copies."""
    center, member = indexed(center), indexed(member)
    return matched(center, member, max(fewest(center[2], least), fewest(member[2], least)), least)


def matched(center: tuple, member: tuple, different: int, least: int) -> list[tuple[int, int, int, int, float]]:
    """Matches of two indexed regions, one of which holds so many different shingles in every stretch of at least least.

    All matches are one run at first. A run that is too unlike as a whole is split at its widest gap, down to
    exact runs; so is the part of center that it is compared with. Different shingles of a range are counted
    where the place before that has the same lies outside.
    """
    (values, theirs, before_theirs), (own_values, own, before_own) = center, member
    place = np.minimum(np.searchsorted(values, own_values), len(values) - 1)
    common_values = values[place] == own_values if len(values) else np.zeros(len(own_values), bool)
    if np.count_nonzero(common_values) < max(1, SIMILARITY * different - 1e-9):
        return []
    held, out = common_values[own], []
    def long(*ranges: np.ndarray) -> list[np.ndarray]:
        return [x for x in ranges if len(x) and x[-1] - x[0] + 1 >= least]

    runs = long(np.flatnonzero(held))
    while runs:
        run = runs.pop()
        a, b = int(run[0]), int(run[-1]) + 1
        fresh = before_own[a:b] < a
        n_own = np.count_nonzero(fresh)
        parts = []
        if np.count_nonzero(fresh & held[a:b]) >= SIMILARITY * n_own:
            wanted = np.zeros(len(values), bool)
            wanted[place[own[run]]] = True
            hit = wanted[theirs]
            parts = long(np.flatnonzero(hit))
        while parts:
            far = parts.pop(max(range(len(parts)), key=lambda i: len(parts[i])))
            c, d = int(far[0]), int(far[-1]) + 1
            fresh = before_theirs[c:d] < c
            n_theirs, both = np.count_nonzero(fresh), np.count_nonzero(fresh & hit[c:d])
            similarity = both / (n_own + n_theirs - both)
            if similarity >= SIMILARITY:
                out.append((c, d - c, a, b - a, similarity))
                break
            if both >= SIMILARITY * n_own and (gaps := far[1:] - far[:-1]).max() > 1:
                at = int(gaps.argmax()) + 1
                parts += long(far[:at], far[at:])
        else:
            gaps = run[1:] - run[:-1]
            if gaps.max() > 1:
                at = int(gaps.argmax()) + 1
                runs += long(run[:at], run[at:])
    return out


def _verified(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in common.runs(batches, "tile"):
            is_pair, out = tile.column("center").is_valid(), []
            columns = (tile.filter(pc.invert(is_pair)).column(n).to_pylist() for n in ("region", "doc", "low", "shingles"))
            held, known = {r: own for r, *own in zip(*columns, strict=True)}, {}
            for pair in zip(*(tile.filter(is_pair).column(n).to_pylist() for n in ("region", "center")), strict=True):
                (m_doc, m_low, _), (c_doc, c_low, _) = (held[r] for r in pair)
                if m_doc == c_doc:
                    continue
                for r in pair:
                    if r not in known:
                        own = indexed(np.frombuffer(held[r][2], np.uint64))
                        known[r] = own, fewest(own[2], least)
                (mine, m_different), (theirs, c_different) = (known[r] for r in pair)
                for c, c_size, m, m_size, similarity in matched(theirs, mine, max(m_different, c_different), least):
                    out.append((*pair, m, m + m_size - 1, c, c + c_size - 1, m_doc, m_low + m, m_size + WIDTH - 1, c_doc, c_low + c, c_size + WIDTH - 1, similarity))
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, *_FOUND_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], LINK)

    return rows


def _compared(pairs: DataFrame, regions: DataFrame, parts: int, least: int) -> DataFrame:
    """Verified near copies of stored pairs (member, center) of regions of different documents.

    Pairs are dealt to tiles by both regions, and a tile is sent each of its regions once.
    """
    side = max(8, int(np.ceil((2 * parts) ** 0.5)))
    row, column = (F.pmod(F.xxhash64(n), F.lit(side)) for n in ("member", "center"))
    pairs = pairs.select((row * side + column).alias("tile"), "member", "center")
    wanted = pairs.select("tile", F.col("member").alias("region")).union(pairs.select("tile", "center")).distinct()
    held = wanted.join(regions.select("region", "doc", "low", "shingles").hint("merge"), "region")
    rows = held.select("tile", "region", F.lit(None).cast("long").alias("center"), "doc", "low", "shingles")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("doc", "long"), ("low", "int"), ("shingles", "binary"))]
    rows = rows.union(pairs.select("tile", F.col("member").alias("region"), "center", *nothing))
    return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_verified(least), LINK_SCHEMA)


def in_common(least: int) -> int:
    """IN_COMMON, or as many different shingles as copies of so many share at least, if none occurs REPEATED times."""
    return max(1, min(IN_COMMON, int(np.ceil(SIMILARITY * least / (REPEATED - 1) - 1e-9))))


def prefixes(order: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Where, in rows of shingles with a place in one order, a stretch of so many has it and few before it.

    These are a fifth, which a copy may lack, and those that are the first of IN_COMMON that the copy has.
    Different shingles count, which are at most those whose place does not repeat the one just before, and one more
    where the stretch begins. The order is cut at some shares of each row's shingles, and what comes before the cut
    counts as before: no place is missed, some more are taken.
    """
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    sizes = np.diff(np.append(starts, len(row)))
    by = np.lexsort((order, row))
    again = np.zeros(len(row), bool)  # not the first time that the row holds it; lexsort is stable
    again[by[1:]] = (row[by[1:]] == row[by[:-1]]) & (order[by[1:]] == order[by[:-1]])
    number = np.repeat(np.arange(len(starts)), sizes)
    gain = np.ones(len(row), np.int64)
    gain[1:] = (row[1:] != row[:-1]) | (order[1:] != order[:-1])
    slack = (PER_LOSS + 1) * (in_common(least) - 1) + 1
    out = np.zeros(len(row), bool)
    limits = [order[by[starts + (sizes * share).astype(np.int64)]] for share in CUTS] if len(row) else []
    for i, limit in enumerate(limits):
        own = after = order >= limit[number]
        if i + 1 < len(limits):
            own = after & (order < limits[i + 1][number])
        if i:
            own &= _covered(np.where(after, gain, np.where(again, 0, -PER_LOSS)), number, least, slack)
        out |= own
    return out


def _nodes(least: int):
    """Passages of each region; those that have so many shingles in common are one, named by a number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.runs(batches, "region"):
            region, out, node, reach = table.column("region")[0].as_py(), [], 0, -1
            for a, b in sorted(zip(table.column("low").to_pylist(), table.column("high").to_pylist(), strict=True)):
                if reach - a + 1 < least:
                    node = _number(np.array([region, a], np.int64).tobytes())
                    reach = b
                reach = max(reach, b)
                out.append((region, a, b, node))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["region", "low", "high", "node"])

    return rows


def _ends(links: DataFrame) -> DataFrame:
    """The verified passages of each region as rows (region, low, high)."""
    ends = [links.select(*(F.col(c).alias(n) for c, n in zip(side, ("region", "low", "high"), strict=True))) for side in SIDES]
    return ends[0].union(ends[1]).distinct()


def _labels(links: DataFrame, parts: int, least: int) -> DataFrame:
    """For each region its verified passages as an array of (low, high, label); passages joined by links have one label."""
    nodes = _ends(links).repartition(parts, "region").sortWithinPartitions("region")
    nodes = common.stored(nodes.mapInArrow(_nodes(least), "region long, low int, high int, node long"))
    edges = links
    for side, name in zip(SIDES, "ab", strict=True):
        edges = edges.join(nodes.select(*(F.col(n).alias(c) for c, n in zip(side, ("region", "low", "high"), strict=True)), F.col("node").alias(name)), list(side))
    components = common.connected_components(edges.select("a", "b").distinct())
    labelled = nodes.join(components, "node", "left").select("region", F.struct("low", "high", F.coalesce("component", "node").alias("label")).alias("passage"))
    return common.stored(labelled.groupBy("region").agg(F.collect_list("passage").alias("passages")))


def constant(tokens: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """What lies in a stretch of at least so many within one row that consists of one shingle."""
    fresh = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])])) if len(tokens) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(fresh, len(tokens)))
    return np.repeat(sizes >= least, sizes)


def _places(filters: Broadcast, parts: int, least: int):
    """For each region where its prefixes' shingles are, the shingles and their weights.

    Copies that have but one shingle in common consist of it, since they have four fifths of each other's: it has the
    weight of IN_COMMON in both.
    """

    def made(regions: list[tuple]) -> pa.RecordBatch:
        hashes = [np.frombuffer(r[1], np.uint64) for r in regions]
        sizes = [len(h) for h in hashes]
        tokens, row = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.repeat(np.arange(len(sizes)), sizes)
        keys, level = _keys(tokens, parts), np.zeros(len(tokens), np.uint64)
        for words in filters.value[1:]:
            level += _passes(keys, words)
        at = np.flatnonzero(prefixes(level << np.uint64(62) | tokens >> np.uint64(2), row, least) & _passes(keys, filters.value[0]))
        weights = np.where(constant(tokens, row, least), in_common(least), 1).astype(np.uint8)[at]
        cuts = np.searchsorted(row[at], np.arange(len(sizes) + 1)).tolist()
        inner, tokens = (at - (np.cumsum(sizes) - sizes)[row[at]]).astype(np.int32) if sizes else at, tokens[at]
        blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (inner, tokens, weights)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in regions], pa.int64()), pa.array(sizes, pa.int32()), *blobs], PLACES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(r)
                size += len(r[1]) // 8
                if size >= COUNT_AT_ONCE // 4:
                    yield made(held)
                    held, size = [], 0
        yield made(held)

    return rows


def _holders(parts: int, least: int):
    """Blobs by part of (shingle, region, label, weight) for the prefixes of regions; a label names the passage's class.

    What lies between or beside passages and is too short for one has its neighbour's label: a passage that
    holds some of it overlaps the neighbour.
    """

    def labelled(region: int, n: int, passages: list[dict] | None) -> np.ndarray:
        label, within = np.full(n, region, np.int64), np.zeros(n, bool)
        for p in sorted(passages or (), key=lambda p: (-p["label"], p["low"])):
            label[p["low"] : p["high"] + 1], within[p["low"] : p["high"] + 1] = p["label"], True
        for a, b in _spans(~within) if passages else ():
            if b - a + 1 < least:
                label[a : b + 1] = label[a - 1] if a else label[b + 1]
        return label

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate([np.zeros(0, HOLDER), *held])
        order, full, cuts = _dealt(entries["token"], parts)
        entries = entries[order]
        blobs = [entries[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(full), pa.array(blobs[: len(full)], pa.binary())], ["part", "blob"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for region, n, at, tokens, weights, passages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.zeros(len(weights), HOLDER)
                own["token"], own["region"], own["weight"] = np.frombuffer(tokens, np.uint64), region, np.frombuffer(weights, np.uint8)
                own["label"] = labelled(region, n, passages)[np.frombuffer(at, np.int32)]
                held.append(own)
                size += len(own)
                if size >= COUNT_AT_ONCE // 4:
                    yield made(held)
                    held, size = [], 0
        yield made(held)

    return rows


def _pairs(x: np.ndarray, y: np.ndarray, token: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Pairs of different regions with the sum of their weights, of each shingle's once."""
    low, high, token, weight = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], token[x != y], weight[x != y].astype(np.int64)
    by = np.lexsort((-weight, token, low, high))
    low, high, token, weight = low[by], high[by], token[by], weight[by]
    once = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (token[1:] != token[:-1])])) if len(low) else np.zeros(0, np.int64)
    low, high, weight = low[once], high[once], weight[once]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, first) if len(first) else weight
    return pa.RecordBatch.from_arrays([pa.array(high[first]), pa.array(low[first]), pa.array(total)], ["member", "center", "weight"])


def _met(turn: int | None):
    """Pairs of regions that hold a shingle under different labels: all, or in some turn each with one of the commonest label."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        entries = np.frombuffer(b"".join(blobs), HOLDER)
        del blobs
        if not len(entries):
            return
        entries = entries[np.lexsort((-entries["weight"].astype(np.int8), entries["region"], entries["label"], entries["token"]))]
        again = np.zeros(len(entries), bool)
        again[1:] = entries[["token", "region", "label"]][1:] == entries[["token", "region", "label"]][:-1]
        entries = entries[~again]
        token, region, label, weight = (np.ascontiguousarray(entries[n]) for n in HOLDER.names)
        fresh = np.concatenate([[True], token[1:] != token[:-1]])
        other = fresh | np.concatenate([[True], label[1:] != label[:-1]])
        at = np.arange(len(token))
        start, mine = np.maximum.accumulate(np.where(fresh, at, 0)), np.maximum.accumulate(np.where(other, at, 0))
        if turn is not None:
            groups = np.flatnonzero(other)
            sizes = np.diff(np.append(groups, len(token)))
            of = np.cumsum(fresh)[groups] - 1
            by = np.lexsort((-sizes, of))
            chief = by[np.flatnonzero(np.concatenate([[True], of[by][1:] != of[by][:-1]]))][np.cumsum(fresh) - 1]
            own = np.flatnonzero(label != label[groups[chief]])
            one = common.mix(token[own] ^ region[own].view(np.uint64) + np.uint64(turn)) % sizes[chief[own]].astype(np.uint64)
            theirs = groups[chief[own]] + one.astype(np.int64)
            for a in range(0, len(own), PAIRS_AT_ONCE):
                x, y = own[a : a + PAIRS_AT_ONCE], theirs[a : a + PAIRS_AT_ONCE]
                yield _pairs(region[x], region[y], token[x], np.minimum(weight[x], weight[y]))
            return
        n = mine - start  # of the same shingle under an earlier label
        ends = np.cumsum(n)
        a = 0
        while a < len(n):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
            x = np.repeat(at[a:b], n[a:b])
            y = np.repeat(start[a:b] - (ends[a:b] - n[a:b]), n[a:b]) + done + np.arange(len(x))
            yield _pairs(region[x], region[y], token[x], np.minimum(weight[x], weight[y]))
            a = b

    return rows


def stretch_hashes(shingles: np.ndarray, least: int) -> np.ndarray:
    """A 64-bit number for every stretch of so many shingles."""
    up, down = common._powers_to(len(shingles))
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(common.mix(shingles) * up[: len(shingles)], out=sums[1:])
    return common.mix((sums[least:] - sums[:-least]) * down[: len(sums) - least])


def _open(least: int, parts: int, bits: Broadcast | None = None):
    """Hashes of exact stretches that no verified passage covers whole; with a filter, blobs by part of its stretches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, low, piece, passages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = np.frombuffer(piece, np.uint64)
                hashes, covered_to = stretch_hashes(shingles, least), np.zeros(len(shingles), np.int64)
                for p in passages or ():
                    covered_to[p["low"]] = max(covered_to[p["low"]], p["high"] + 1)
                entries = np.zeros(len(hashes), SAME)
                entries["value"], entries["doc"], entries["at"] = hashes, doc, low + np.arange(len(hashes))
                entries["open"] = np.maximum.accumulate(covered_to)[: len(hashes)] < np.arange(len(hashes)) + least
                if bits is None:
                    entries = entries[entries["open"]]
                else:
                    entries = entries[_passes(common.mix(hashes), bits.value)]
                held.append(entries)
                size += len(entries)
            if size >= AT_ONCE:
                yield made(np.concatenate(held))
                held, size = [], 0
        yield made(np.concatenate([np.zeros(0, SAME), *held]))

    def made(entries: np.ndarray) -> pa.RecordBatch:
        if bits is None:
            values = np.unique(entries["value"])
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([len(values)], pa.int64()), pa.array([values.tobytes()], pa.binary())], ["level", "n", "blob"])
        entries = entries[_partners(entries)[1]]
        order, full, cuts = _dealt(entries["value"], parts)
        entries = entries[order]
        blobs = [entries[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(full), pa.array(blobs[: len(full)], pa.binary())], ["part", "blob"])

    return rows


def _partners(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the first of its value in another document, or -1; and which entries are open or the first of a value's first two documents."""
    by = np.lexsort((entries["at"], entries["doc"], entries["value"]))
    value, doc = entries["value"][by], entries["doc"][by]
    fresh, own = np.ones(len(by), bool), np.ones(len(by), bool)
    fresh[1:] = value[1:] != value[:-1]
    own[1:] = fresh[1:] | (doc[1:] != doc[:-1])
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    which = np.cumsum(own) - np.cumsum(own)[first][group] if len(by) else group  # 0 for a value's first document, then 1
    second = np.full(len(first), -1)
    at = np.flatnonzero(own & (which == 1))
    second[group[at]] = at
    partner = np.where(which > 0, first[group], second[group]) if len(by) else group
    out, kept = np.full(len(by), -1), np.zeros(len(by), bool)
    out[by] = np.where(partner >= 0, by[partner], -1) if len(by) else out
    kept[by] = own & (which <= 1)
    return out, kept | entries["open"]


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open stretches and the first place in another document that has the same."""
    entries = np.frombuffer(b"".join(x for batch in batches for x in batch.column("blob").to_pylist()), SAME)
    partner = _partners(entries)[0]
    own = np.flatnonzero(entries["open"] & (partner >= 0))
    theirs = partner[own]
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (entries["doc"][own], entries["at"][own], entries["doc"][theirs], entries["at"][theirs])], ["doc", "at", "other", "other_at"])


def _copies(least: int):
    """Consecutive equal stretches as one passage."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.runs(batches, "doc"):
            at, other, theirs = (table.column(n).to_numpy().astype(np.int64) for n in ("at", "other", "other_at"))
            order = np.lexsort((at, theirs - at, other))
            at, other, theirs = at[order], other[order], theirs[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (other[1:] != other[:-1]) | (theirs[1:] - at[1:] != theirs[:-1] - at[:-1]) | (at[1:] - at[:-1] > 1)
            first = np.flatnonzero(fresh)
            words = (at[np.append(first[1:], len(at)) - 1] - at[first] + least + WIDTH - 1).astype(np.int32)
            columns = (np.full(len(first), table.column("doc")[0].as_py()), at[first].astype(np.int32), words, other[first], theirs[first].astype(np.int32), words, np.ones(len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], FOUND)

    return rows


def repeated(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least min_words words that other documents hold too, each with one place where.

    doc_id, start_word, n_words, other_id, other_start, other_words, similarity; every pair is given both
    ways. Copies are joined to one of them, not to each other.
    """
    docs = common.texts(documents)
    spark = docs.sparkSession
    common.prepare(spark)
    parts, least = common.partitions(spark), min_words - WIDTH + 1

    often = docs.select("text").mapInArrow(_counts(parts, least), "part int, blob binary")
    often = common.stored(often.repartitionById(parts, F.col("part")).mapInArrow(_often, "level int, n long, blob binary"))
    filters = spark.sparkContext.broadcast(_filters(often))
    every = common.stored(docs.mapInArrow(_regions(filters, parts, least), REGION_SCHEMA))
    regions = every.where("doc is not null").select(*REGION).repartition(parts, "key").sortWithinPartitions("key", "doc", "low")
    regions = common.stored(regions.mapInArrow(_distinct, REGION_SCHEMA))
    copies = [t.where("doc is null").select(*FOUND) for t in (every, regions)]
    regions = regions.where("doc is not null").select(*REGION)

    met = regions.select("region", "shingles").mapInArrow(_windows(parts, least), f"part int, blob binary, {EDGE_SCHEMA}")
    met = met.withColumn("part", F.coalesce("part", F.pmod(F.xxhash64("member"), F.lit(parts)).cast("int")))
    edges = met.repartitionById(parts, F.col("part")).mapInArrow(_shared, EDGE_SCHEMA)
    pairs = edges.repartition(parts, "member").sortWithinPartitions("member", "center").mapInArrow(_candidates(least), "member long, center long")
    tried = [common.stored(pairs)]
    links = [common.stored(_compared(tried[0], regions, parts, least))]
    labels = _labels(links[0], parts, least)
    places = common.stored(regions.select("region", "shingles").mapInArrow(_places(filters, parts, least), PLACES_SCHEMA))
    for turn in [*range(ROUNDS), None]:
        if turn and links[-1].isEmpty():
            continue
        held = places.join(labels, "region", "left").mapInArrow(_holders(parts, least), "part int, blob binary")
        pairs = held.repartitionById(parts, F.col("part")).mapInArrow(_met(turn), PAIR_SCHEMA)
        pairs = pairs.groupBy("member", "center").agg(F.sum("weight").alias("weight"))
        if turn is None:
            pairs = pairs.where(F.col("weight") >= in_common(least))
        pairs = pairs.select("member", "center").join(functools.reduce(DataFrame.union, tried), ["member", "center"], "left_anti")
        tried.append(common.stored(pairs))
        links.append(common.stored(_compared(tried[-1], regions, parts, least)))
        if turn is not None and not links[-1].isEmpty():
            labels = _labels(functools.reduce(DataFrame.union, links), parts, least)
    passages = _ends(functools.reduce(DataFrame.union, links)).groupBy("region").agg(F.collect_list(F.struct("low", "high")).alias("passages"))
    held = common.stored(regions.join(passages, "region", "left").select("doc", "low", "shingles", "passages"))
    bits = common.stored(held.mapInArrow(_open(least, parts), "level int, n long, blob binary"))
    bits = spark.sparkContext.broadcast(_filters(bits, 1)[0])
    same = held.mapInArrow(_open(least, parts, bits), "part int, blob binary").repartitionById(parts, F.col("part"))
    same = same.mapInArrow(_same, "doc long, at int, other long, other_at int").repartition(parts, "doc").sortWithinPartitions("doc")

    found = functools.reduce(DataFrame.union, links).select(*FOUND).union(same.mapInArrow(_copies(least), FOUND_SCHEMA))
    back = found.select(*(F.col(n).alias(m) for n, m in zip([*FOUND[3:6], *FOUND[:3], FOUND[6]], FOUND, strict=True)))
    return found.union(back).union(copies[0]).union(copies[1]).distinct()
