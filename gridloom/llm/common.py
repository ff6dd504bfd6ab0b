"""What the corpus operators share: stored intermediates, vectorised word hashes and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship

#: Rows and bytes of one Arrow batch sent to a Python worker; a longer text travels alone.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Bytes of text that numpy handles at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and keep what one Arrow batch holds small, whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a stored table that all its readers have read in full; what they gave must be stored itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *taken: Iterable[str]) -> str:
    """A column name like name that is none of those taken, in upper or lower case."""
    low = {t.lower() for names in taken for t in names}
    while name.lower() in low:
        name += "_"
    return name


def fixed(df: DataFrame) -> DataFrame:
    """df with its rows kept in their present partitions and order, by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash; rows without doc_id are left out."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


# --- words as numbers -------------------------------------------------------------------------

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = numbers(256, 11)
_LOWERED = _VALUES.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_STEPS = numbers(64, 23)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers = (out[0], out[1])
    return _powers


class Chunk:
    """Some consecutive texts as bytes: data, and bounds[i]:bounds[i + 1] for the text of row first + i."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds, self.n = first, data, bounds, len(bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each text its range of words (one longer than the texts)."""
        solid = ~SPACES[self.data]
        before = np.zeros(len(solid), bool)
        before[1:] = solid[:-1]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(solid))]
        before[inner] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        after[inner - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit number for each word, A-Z taken as a-z where lower is set."""
        up, down = _powers_to(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _VALUES)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in chunks of about limit bytes; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the width-word shingles in order, and for each text its range of them.

    A text with fewer words has its whole sequence as one shingle, a text without words has none.
    """
    starts, ends, ranges = chunk.words()
    words = chunk.word_hashes(starts, ends)
    counts = np.diff(ranges)
    held = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(held.sum()), np.uint64)
    bounds = np.concatenate([[0], np.cumsum(held)])
    if len(words) >= width:
        sums = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            sums += words[j : len(words) - width + 1 + j] * _STEPS[j]
        sums = mix(sums)
        owner = np.repeat(np.arange(chunk.n), counts)
        at = np.arange(len(sums))
        good = owner[at] == owner[at + width - 1]
        full = np.repeat(counts >= width, held)
        out[full] = sums[good]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[ranges[i] : ranges[i + 1]]
        out[bounds[i]] = mix(np.array([(own * _STEPS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, bounds


# --- connected components ---------------------------------------------------------------------


#: Edges that one call contracts at a time.
EDGES_AT_ONCE = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the same components as this partition's, one at most for each node of so many edges."""

    def contracted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            fresh = label.copy()
            np.minimum.at(fresh, label[x], low)
            np.minimum.at(fresh, label[y], low)
            while not np.array_equal(jumped := fresh[fresh], fresh):
                fresh = jumped
            if np.array_equal(fresh, label):
                break
            label = fresh
        other = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[other]]), pa.array(nodes[other])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= EDGES_AT_ONCE:
            yield contracted(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
            held = []
    if held:
        yield contracted(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))


#: A key that holds one row in so many, and this many rows at least, is looked up by broadcast: there are no more such keys.
HOT_KEYS, HOT_ROWS = 512, 256


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys, HOT_KEYS at most, that hold so large a share of the rows of a stored table that they need care."""
    counts = rows.groupBy(key).agg(F.count("*").alias("m"))
    least = max(HOT_ROWS, -(-rows.count() // HOT_KEYS))
    return [r[0] for r in counts.where(F.col("m") >= least).collect()]


def looked_up(rows: DataFrame, key: str, table: DataFrame, hot: list, how: str = "inner") -> DataFrame:
    """rows joined with a table that has each key once. Rows of the hot keys stay where they are, the others are dealt."""
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.where(is_hot))  # a row for each hot key, HOT_KEYS at most
    return rows.where(~is_hot).join(table.where(~is_hot), key, how).unionByName(rows.where(is_hot).join(few, key, how))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is one of the component's nodes.

    Each round contracts what edges of one partition connect, hooks every node to the least of its
    neighbours and itself, jumps once more, and contracts the edges by that. Nodes should be hashes: then
    the edges left shrink by a constant factor a round. The least neighbour is aggregated before the
    shuffle, and nodes that a share of all edges or labels name are looked up by broadcast, so that hubs are no
    hot keys.
    """
    prepare(edges.sparkSession)
    left = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    left = stored(left.distinct().mapInArrow(_forest, "a long, b long"))
    nodes = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        if len(hooks) == rounds:
            raise RuntimeError(f"components not found in {rounds} rounds")
        both = left.union(left.select("b", "a")).toDF("node", "next")
        first = both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("next"))
        first = stored(first)
        second = first.select(F.col("node").alias("next"), F.col("next").alias("last"))
        hook = stored(looked_up(first, "next", second, hot_keys(first, "next")).select("node", F.col("last").alias("next")))
        discard(first)
        hooks.append(hook)
        a = looked_up(left, "a", hook.select(F.col("node").alias("a"), F.col("next").alias("a2")), hot_keys(left, "a"))
        b = looked_up(a, "b", hook.select(F.col("node").alias("b"), F.col("next").alias("b2")), hot_keys(left, "b"))
        further = b.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct()
        before, left = left, stored(further.mapInArrow(_forest, "a long, b long"))
        discard(before)
    out = nodes.withColumn("component", F.col("node"))
    for hook in hooks:
        step = hook.select(F.col("node").alias("component"), F.col("next").alias("further"))
        before, out = out, stored(looked_up(out, "component", step, hot_keys(out, "component") if hook is not hooks[0] else [], "left").select("node", F.coalesce("further", "component").alias("component")))
        discard(before if hook is not hooks[0] else nodes)
        discard(hook)
    return out if hooks else stored(out)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of some batches at a time, about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(h.num_rows for h in held) >= rows:
            yield [np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(held[0].num_columns)]
            held = []
    if held:
        yield [np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(held[0].num_columns)]


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which a partition is sorted, one value at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[-1].column(column)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
