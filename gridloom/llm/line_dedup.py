"""Line dedup: range-partitioned line hashes, streamed in order, give a keep bitmap for each document.

A line's key is the line stripped of ASCII white space with A-Z lowered. Keys of at least min_chars code
points that at least min_documents documents hold lose all their lines except in the largest doc_id.
Only hashes, ids and positions are shuffled; texts are not. Keys are dealt by range of (hash, doc_id), so
a key that a third of all documents hold spreads over many partitions; what each partition knows of its
first and last key is carried over in one small row. Within a partition rows stream by in order: what a task
holds are a stretch of rows and, of the key it is in, those seen until it is known to be common.

Defined cases: a null or empty text is one empty line; rows whose doc_id is null are left out; equal keys
within one document count once and stay or go together; rows of the same doc_id and text share a bitmap,
rows of the same doc_id with other texts count as one document with a bitmap each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

SPACE = " \t\n\x0b\x0c\r"
LINE_SCHEMA = "high long, low long, backwards long, version long, position int"


def _versions(documents: DataFrame) -> DataFrame:
    docs = common.texts(documents).withColumn("text", F.coalesce("text", F.lit("")))
    common.prepare(docs.sparkSession)
    return docs.withColumn("version", F.xxhash64("text"))


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, versions = (batch.column(n).to_numpy() for n in ("doc_id", "version"))
            owner, position, digests = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for p, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
                        owner.append(i)
                        position.append(p)
                        digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            own = np.array(owner, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(-docs[own]), pa.array(versions[own]), pa.array(np.array(position, np.int32))], ["high", "low", "backwards", "version", "position"])

    return rows


def _runs(high: np.ndarray, low: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows: number of the key of each row, first rows of the keys, number of documents of each key."""
    fresh = np.ones(len(high), bool)
    fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    other = fresh.copy()
    other[1:] |= back[1:] != back[:-1]
    key = np.cumsum(fresh) - 1
    return key, np.flatnonzero(fresh), np.bincount(key, other).astype(np.int64)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its number, first and last key and how many documents it has for them."""
    first = last = None  # key, documents; and of the last key the last document
    for high, low, back, *_ in common.gathered(batches):
        _, at, documents = _runs(high, low, back)
        keys = [(int(high[i]), int(low[i])) for i in (at[0], at[-1])]
        if last is not None and keys[0] == last[0]:
            documents[0] += last[1] - int(back[0] == last[2])
            if first[0] == keys[0]:
                first = (keys[0], int(documents[0]))
        if first is None:
            first = (keys[0], int(documents[0]))
        last = (keys[1], int(documents[-1]), int(back[-1]))
    if first is not None:
        values = [TaskContext.get().partitionId(), *first[0], first[1], *last[0], last[1]]
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in values], ["part", "high", "low", "n", "high2", "low2", "n2"])


class Sweep:
    """The lines that go, from rows in order, a stretch at a time.

    What it holds between stretches are the rows of one key of which fewer than least documents were seen yet, or
    that key and its keeper. head and tail are the partition's first and last key with the documents that other
    partitions have for them: before the head there is its keeper, too.
    """

    def __init__(self, least: int, head: tuple, tail: tuple):
        self.least, self.head, self.tail = least, head, tail
        self.held: list[np.ndarray] | None = None
        self.going: tuple | None = None  # key and keeper

    def _judged(self, rows: list[np.ndarray], whole: bool) -> Iterator[list[np.ndarray]]:
        """Of rows with whole keys (or of the rows so far of one key): those that go, once that is known."""
        high, low, back = rows[:3]
        if not len(high):
            return
        key, at, documents = _runs(high, low, back)
        for i, (name, elsewhere) in ((0, self.head), (-1, self.tail)):
            if (int(high[at[i]]), int(low[at[i]])) == name:
                documents[i] += elsewhere
        if not whole and documents[-1] < self.least:
            self.held = rows
            return
        has_keeper = np.ones(len(at), bool)
        has_keeper[0] = not (self.head[1] and (int(high[0]), int(low[0])) == self.head[0])
        if not whole:
            self.going = ((int(high[-1]), int(low[-1])), int(back[at[-1]]) if has_keeper[-1] else None)
        go = (documents[key] >= self.least) & ~(has_keeper[key] & (back == back[at][key]))
        yield [c[go] for c in rows]

    def stretch(self, rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        if self.going is not None:
            (high, low), keeper = self.going
            n = int(((rows[0] == high) & (rows[1] == low)).sum())
            go = np.ones(n, bool) if keeper is None else rows[2][:n] != keeper
            yield [c[:n][go] for c in rows]
            rows = [c[n:] for c in rows]
            if not len(rows[0]):
                return
            self.going = None
        if self.held is not None:
            rows, self.held = [np.concatenate(x) for x in zip(self.held, rows, strict=True)], None
        inner = int(np.argmax((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])))
        yield from self._judged([c[:inner] for c in rows], True)
        yield from self._judged([c[inner:] for c in rows], False)

    def end(self) -> Iterator[list[np.ndarray]]:
        if self.held is not None:
            yield from self._judged(self.held, True)


def dropped_lines(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """(doc_id, version, position) of every line that goes; version is xxhash64 of the document's text."""
    spark = documents.sparkSession
    # Stored, since dealing by range reads its input twice.
    lines = common.stored(_versions(documents).mapInArrow(_line_rows(min_chars), LINE_SCHEMA))
    dealt = lines.repartitionByRange(common.partitions(spark), "high", "low", "backwards").sortWithinPartitions("high", "low", "backwards", "position")
    dealt = common.fixed(dealt)
    common.discard(lines)
    edges = dealt.mapInArrow(_edges, "part long, high long, low long, n long, high2 long, low2 long, n2 long").collect()  # a row for each partition
    before: dict[int, int] = {}
    after: dict[int, int] = {}
    for seen, order, ends in ((before, sorted(edges), (slice(1, 4), slice(4, 7))), (after, sorted(edges, reverse=True), (slice(4, 7), slice(1, 4)))):
        running: tuple = (None, 0)
        for e in order:
            near, far = e[ends[0]], e[ends[1]]
            seen[e[0]] = running[1] if running[0] == near[:2] else 0
            running = (far[:2], far[2] + (seen[e[0]] if near[:2] == far[:2] else 0))

    ends_of = {e[0]: e for e in edges}

    def drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = ends_of.get(TaskContext.get().partitionId())
        if e is None:
            return
        sweep = Sweep(min_documents, (tuple(e[1:3]), before[e[0]]), (tuple(e[4:6]), after[e[0]]))

        def gone() -> Iterator[list[np.ndarray]]:
            for rows in common.gathered(batches):
                yield from sweep.stretch(rows)
            yield from sweep.end()

        for _, _, back, version, position in gone():
            yield pa.RecordBatch.from_arrays([pa.array(-back), pa.array(version), pa.array(position)], ["doc_id", "version", "position"])

    return dealt.mapInArrow(drops, "doc_id long, version long, position int")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("positions")
        values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            keep = np.ones(int(values[a:b].max()) // 8 * 8 + 8, bool)
            keep[values[a:b]] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(out, pa.binary())], ["doc_id", "version", "keep"])


def keep_bitmaps(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """(doc_id, version, keep) of every document that loses lines.

    keep is a zlib-compressed bitmap, a bit for each line from the first on, 1 where the line stays;
    lines beyond its end stay, and documents without a row keep all their lines.
    """
    gone = dropped_lines(documents, min_chars, min_documents)
    return gone.groupBy("doc_id", "version").agg(F.collect_list("position").alias("positions")).mapInArrow(_bitmaps, "doc_id long, version long, keep binary")


def _kept(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text that stays, its number of lines before, and how many of them went."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    bits += [1] * (len(lines) - len(bits))
    stay = [line for line, bit in zip(lines, bits, strict=True) if bit]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text and the columns of extra) with text cut down, and n_lines and n_dropped.

    Columns of extra may have any name; those called like a column of the result are left out.
    """
    common.prepare(documents.sparkSession)
    own = ("doc_id", "text", "n_lines", "n_dropped")
    extra = tuple(n for n in extra if n.lower() not in own)
    version, doc, of, keep = (common.unused(n, extra, own) for n in ("_version", "_doc", "_of", "_keep"))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).where("doc_id is not null").withColumn(version, F.xxhash64("text"))
    maps = bitmaps.select(F.col("doc_id").alias(doc), F.col("version").alias(of), F.col("keep").alias(keep))
    rows = docs.join(maps, (F.col("doc_id") == F.col(doc)) & (F.col(version) == F.col(of)), "left").select("doc_id", "text", *extra, keep)
    schema = rows.drop(keep).schema.add("n_lines", "long").add("n_dropped", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_kept(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column(keep).to_pylist(), strict=True)]
            kept = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept[0], *(batch.column(n) for n in extra), *kept[1:]], ["doc_id", "text", *extra, "n_lines", "n_dropped"])

    return rows.mapInArrow(cut, schema)


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = common.texts(documents)
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
