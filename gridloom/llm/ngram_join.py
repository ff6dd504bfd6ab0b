"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound the overlap, exact sorted intersections.

A document's set is its distinct word shingles as 64-bit hashes; documents with equal sets are one class
from the first step on, so copies are never paired. Which classes can meet in a tile at all is settled
without losing a link: in any fixed order of all shingles, two linked sets share one of their first
n - ceil(t n) + 1 shingles. The order here is: shingles whose hash is in the lowest quarter, rarest first
by their exact document count; then the other hashes; last the few shingles that a share of all documents
hold (found over all documents). A class whose rare, unshared shingles fill that prefix can link with
nothing and drops out. The rest fall into candidate components; each is cut into bands of size and blocks
within them, and every two blocks of the same or neighbouring bands make a tile. In a tile, bit counts of
bitmaps bound the overlap from above, and every pair that passes is intersected. A tile gives the links that
connect what is linked in it, and for each class the number of documents linked to it.

Defined cases: a text with fewer words than a shingle is one shingle, an empty or null text has none and
links with nothing; rows whose doc_id is null are left out; rows that share a doc_id are documents of
their own, each with its set, and count with that id. Documents with the same set are linked to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Hashes below this are counted over all documents.
COUNTED = np.uint64(1 << 62)
#: A shingle held by this share of all documents, and by HOT_LEAST, comes last in the order; at most HOT_MOST do.
HOT_SHARE, HOT_LEAST, HOT_MOST = 1 / 500, 256, 1 << 20
#: Tokens that one map task counts at a time.
COUNT_AT_ONCE = 4 << 20
#: Classes and bytes of sets in a block of a tile.
BLOCK_SETS, BLOCK_BYTES = 2048, 16 << 20
BITMAP_WORDS = 32
#: Shingles of a set's partners that are compared at a time.
SHARED_AT_ONCE = 1 << 20
#: Bits for each id in the filter of the documents whose sets are wanted, and at most; a full filter only lets more pass.
FILTER_EACH, FILTER_MOST = 32, 1 << 28
SECOND, ENTRY = 1 << 40, np.dtype([("token", "<u8"), ("key", "<i8"), ("level", "u1")])


def _key(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0])


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for chunk in common.chunks(column):
        hashes, bounds = common.shingles(chunk, width)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = np.sort(hashes[a:b])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _classes(width: int):
    """Rows (doc_id, n, key) for the documents, and (token, seen) for shingles common within this task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()

        def common_ones() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            often = seen >= max(2, HOT_SHARE * len(known))
            tokens, seen = tokens[often].view(np.int64), seen[often]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(tokens), pa.array(seen.astype(np.int64))], ["doc_id", "n", "key", "token", "seen"])

        for batch in batches:
            sizes, keys = [], []
            for own in _sets(batch.column("text"), width):
                sizes.append(len(own))
                keys.append(_key(own) if len(own) else None)
                if len(own) and keys[-1] not in known:
                    known.add(keys[-1])
                    held.append(own[: np.searchsorted(own, COUNTED)])
                    size += len(held[-1])
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), none, none], ["doc_id", "n", "key", "token", "seen"])
            if size > COUNT_AT_ONCE:
                yield common_ones()
                held, size, known = [], 0, set()
        yield common_ones()

    return rows


def _entries(width: int, percent: int, hot: np.ndarray, parts: int):
    """Blobs of (token, class) by part of the tokens, and a row (key, n, c) for each class; c: counted shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys, sizes, counted = [], [], [], []
            known = set()
            for own in _sets(batch.column("text"), width):
                if not len(own) or (key := _key(own)) in known:
                    continue
                known.add(key)
                is_hot = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)
                first = own[: np.searchsorted(own, COUNTED)]
                first = first[~is_hot[: len(first)]]
                short = _prefix(len(own), percent) - len(first)
                more = [first]
                if short > 0:
                    second = own[(own >= COUNTED) & ~is_hot][:short]
                    more += [second, own[is_hot][: short - len(second)]]
                both = np.zeros(sum(map(len, more)), ENTRY)
                both["token"], both["key"] = np.concatenate(more), key
                both["level"] = np.repeat(np.arange(len(more)), [len(x) for x in more])
                found.append(both)
                keys.append(key)
                sizes.append(len(own))
                counted.append(len(first))
            if not keys:
                continue
            entries = np.concatenate(found)
            part = (entries["token"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            entries, part = entries[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            blobs = [entries[cuts[i] : cuts[i + 1]].tobytes() for i in full]
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), none, none, none], ["part", "blob", "key", "n", "c"])
            own_part = (np.array(keys) % parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own_part), pa.nulls(len(keys), pa.binary()), *(pa.array(x, pa.int64()) for x in (keys, sizes, counted))], ["part", "blob", "key", "n", "c"])

    return rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, token, rank) for the tokens that several classes hold; the classes' own rows pass through."""
    names, blobs = ["key", "n", "c", "token", "rank"], []
    for batch in batches:
        is_blob = batch.column("blob").is_valid()
        blobs += batch.column("blob").filter(is_blob).to_pylist()
        rest = batch.filter(batch.column("key").is_valid())
        none = pa.nulls(rest.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([rest.column("key"), rest.column("n"), rest.column("c"), none, none], names)
    entries = np.frombuffer(b"".join(blobs), ENTRY)
    del blobs
    order = np.lexsort((entries["key"], entries["token"]))
    token, key, level = entries["token"][order], entries["key"][order], entries["level"][order]
    del entries, order
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key, level = token[fresh], key[fresh], level[fresh]
    start = np.ones(len(token), bool)
    start[1:] = token[1:] != token[:-1]
    group = np.cumsum(start) - 1
    df = np.bincount(group)[group] if len(group) else group
    many = df >= 2
    rank = df.astype(np.int64) + level.astype(np.int64) * SECOND
    for a in range(0, int(many.sum()), 1 << 16):
        own = np.flatnonzero(many)[a : a + (1 << 16)]
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), none, none, pa.array(token[own].view(np.int64)), pa.array(rank[own])], names)


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter over the ids of a stored table, of FILTER_MOST bits at most."""
    bits = min(FILTER_MOST, 64 << int(np.ceil(np.log2(max(1, ids.count() * FILTER_EACH / 64)))))
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _payload(width: int, bits: Broadcast):
    """The sets of the documents that pass the filter; most others are not even split into words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            at = batch.column("hash").to_numpy().astype(np.int64) % (len(words) * 64)
            passes = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            own = batch.filter(pa.array(passes.astype(bool)))
            sets = list(_sets(own.column("text"), width))
            keys = [_key(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["one", "key", "shingles"])

    return rows


def _bitmap(own: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_WORDS * 64, bool)
    bits[(own % np.uint64(BITMAP_WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def tile_links(keys: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all that is linked in a tile, and for each class how many documents are linked to it there.

    Pairs of sides 1 and 1, or 2 and 2, are other tiles' work. copies: documents of each class, 1 where not given.
    """
    copies = np.ones(len(keys), np.int64) if copies is None else copies
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sides, sizes = [sets[i] for i in order], sides[order], sizes[order]
    bitmaps = np.array([_bitmap(s) for s in sets])
    # Shingles as ranks among the tile's: the sets stay sorted, and a set's members can be marked in one array.
    distinct, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(distinct), bool)
    root, counts = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    out = []
    last = np.searchsorted(sizes * percent, sizes * 100, "right")
    for a in range(len(keys)):
        if last[a] <= a + 1:
            continue
        at = np.arange(a + 1, last[a])
        at = at[(sides[at] == 0) | (sides[at] != sides[a])]
        apart = np.bitwise_count(bitmaps[at] ^ bitmaps[a]).sum(1, dtype=np.int64)
        both = sizes[a] + sizes[at]
        at = at[(100 + percent) * ((both - apart) // 2) >= percent * both]
        if not len(at):
            continue
        marked[ranks[bounds[a] : bounds[a + 1]]] = True
        for some in np.array_split(at, -(-int(sizes[at].sum()) // SHARED_AT_ONCE)):
            ends = np.cumsum(sizes[some])
            own = np.repeat(bounds[some] - (ends - sizes[some]), sizes[some]) + np.arange(ends[-1])
            overlap = np.add.reduceat(marked[ranks[own]], ends - sizes[some], dtype=np.int64)
            linked = some[100 * overlap >= percent * (sizes[a] + sizes[some] - overlap)]
            counts[a] += copies[order[linked]].sum()
            counts[linked] += copies[order[a]]
            for b in linked[root[linked] != root[a]]:
                if root[b] != root[a]:
                    out.append((int(keys[order[a]]), int(keys[order[b]])))
                    root[root == root[b]] = root[a]
        marked[ranks[bounds[a] : bounds[a + 1]]] = False
    by_class = np.zeros(len(keys), np.int64)
    by_class[order] = counts
    return out, by_class


def _tiles(percent: int):
    """Rows (a, b) for links, and (a, null, links) for the documents linked to a class in a tile."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in common.runs(batches, "tile"):
            sets = [np.frombuffer(b, np.uint64) for b in tile.column("shingles").to_pylist()]
            keys = tile.column("key").to_numpy()
            got, counts = tile_links(keys, sets, tile.column("side").to_numpy(), percent, tile.column("copies").to_numpy())
            some = np.flatnonzero(counts)
            if len(some):
                none = pa.nulls(len(got), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)), none], ["a", "b", "links"])
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some])], ["a", "b", "links"])

    return rows


def _tiled(survivors: DataFrame, percent: int) -> DataFrame:
    """survivors (key, n, component) with tiles: an array of (tile, side).

    Bands are as wide as the largest ratio of linked sizes, so that links stay within a band or between neighbours.
    """
    width = float(-np.log(percent / 100 - 1e-6)) if percent < 100 else 1e-9
    s = survivors.withColumn("band", F.floor(F.log("n") / width))
    bands = s.groupBy("component", "band").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    bands = bands.withColumn("blocks", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("total") * 8 / BLOCK_BYTES)))
    by_component = bands.groupBy("component").agg(F.sum("m").alias("all_m"), F.sum("total").alias("all_total"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    # Stored, so that the join's two sides are dealt anew and adaptive execution may split a large component.
    s = s.join(common.stored(by_component), "component")
    own = F.col("blocks")[F.col("band")]
    s = s.withColumn("i", F.pmod(F.xxhash64("key"), own)).withColumn("own", own)
    none = F.lit(0).cast("long")
    above, below = F.coalesce(F.col("blocks")[F.col("band") + 1], none), F.coalesce(F.col("blocks")[F.col("band") - 1], none)

    def many(count, make):
        return F.transform(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>")), make)

    def tile(b, i, b2, j, side):
        return F.struct(F.xxhash64("component", b, i, b2, j).alias("tile"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))

    band, i = F.col("band"), F.col("i")
    inside = many(F.col("own"), lambda j: tile(band, F.least(i, j), band, F.greatest(i, j), F.when(i == j, 0).when(i < j, 1).otherwise(2)))
    upward = many(above, lambda j: tile(band, i, band + 1, j, 1))
    downward = many(below, lambda j: tile(band - 1, j, band, i, 2))
    small = (F.col("all_m") <= BLOCK_SETS) & (F.col("all_total") * 8 <= BLOCK_BYTES)
    alone = F.array(tile(none, none, none, none, 0))
    return s.select("key", F.when(small, alone).otherwise(F.concat(inside, upward, downward)).alias("tiles"))


def classes(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document.

    Two documents are linked where 100 |A and B| >= percent |A or B|; n_links counts the others linked to a document.
    """
    docs = common.texts(documents)
    spark = docs.sparkSession
    common.prepare(spark)
    parts = common.partitions(spark)
    first = common.stored(docs.select("doc_id", "text").mapInArrow(_classes(width), "doc_id long, n long, key long, token long, seen long"))
    own = first.where("doc_id is not null").select("doc_id", "n", "key")
    frequent = first.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(HOT_LEAST, HOT_SHARE * own.count()))
    hot = np.sort(np.array([r[0] for r in frequent.orderBy(F.desc("seen"), "token").limit(HOT_MOST).select("token").collect()], np.int64).view(np.uint64))

    shared = docs.select("text").mapInArrow(_entries(width, percent, hot, parts), "part int, blob binary, key long, n long, c long")
    shared = shared.repartitionById(parts, F.col("part")).mapInArrow(_shared, "key long, n long, c long, token long, rank long")
    held = shared.groupBy("key").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("rank", "token")))).alias("held"))
    counted = F.size(F.filter("held", lambda x: x["rank"] < SECOND))
    room = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - (F.col("c") - counted)
    held = held.where(F.size("held") > 0).withColumn("room", room.cast("int")).where("room > 0")
    prefixes = common.stored(held.select("key", "n", F.explode(F.slice("held", F.lit(1), F.col("room"))["token"]).alias("token")))

    star = prefixes.groupBy("token").agg(F.min("key").alias("a"), F.count("*").alias("m")).where("m > 1")
    edges = prefixes.join(star, "token").select("a", F.col("key").alias("b"))
    together = common.connected_components(edges)
    survivors = prefixes.select("key", "n").distinct().join(together.withColumnRenamed("node", "key"), "key")
    smallest = common.stored(own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("one"), F.count("*").alias("copies")))
    tiled = common.stored(_tiled(survivors, percent).join(smallest, "key"))

    bits = spark.sparkContext.broadcast(_filter_bits(tiled.select(F.col("one").alias("id"))))
    sets = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(_payload(width, bits), "one long, key long, shingles binary")
    payload = sets.join(tiled.hint("merge"), ["one", "key"]).select("key", "copies", "shingles", F.explode("tiles").alias("t")).select("t.tile", "t.side", "key", "copies", "shingles")
    links = common.stored(payload.repartition(parts, "tile").sortWithinPartitions("tile", "key").mapInArrow(_tiles(percent), "a long, b long, links long"))
    found = common.connected_components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))

    linked = common.stored(smallest.join(found.withColumnRenamed("node", "key"), "key"))  # classes without links are their own component
    least = linked.groupBy("component").agg(F.min("one").alias("component_id"))
    linked = common.looked_up(linked, "component", least, common.hot_keys(linked, "component")).select("key", "component_id").join(counts, "key", "left")
    ids = common.stored(smallest.join(linked, "key", "left").select("key", F.coalesce("component_id", "one").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = common.looked_up(own, "key", ids, common.hot_keys(own.where("key is not null"), "key"), "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, coalesce(l.n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) l USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
