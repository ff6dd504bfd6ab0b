"""Approximate nearest neighbours by inner product: score-aware anisotropic quantisation.

Pairs of dimensions are quantised to 16 centres each, so a vector is half a byte for each pair. Codes and
centres minimise a loss that weighs the residual's part along the vector more than the part across it,
since only that part moves the scores of queries that matter. Queries turn into tables of 16 scores for
each pair; two pairs share a byte, so a scan adds one table entry for two pairs. The best of each block
of vectors are reranked by exact inner products in double precision.

A coarse partition comes first: vectors belong to the nearest centre, and a query visits the cells whose
centres have the largest products with it. There is a cell for each ROW_BLOCK vectors, CELLS at least and one
for each CELL_SAMPLE vectors of the sample at most. How many a query visits is measured on the half of the sample
that the centres are not fitted on: the fewest by which its nearest vectors there are found but for a share MISSED,
and more where these cells together hold fewer vectors than are asked for.
Where vectors have no clusters, that is most of the cells. Centres are fitted on at most FIT vectors; every
vector is indexed. Queries and vectors meet in tiles: a block of a cell is scanned by a block of the queries that
visit the cell, so vectors are copied for the blocks of these queries alone. What is found depends on the vectors,
not on the cores.

Codes and visits are fitted on a sample, and on other vectors (dimensions or lengths of very unlike sizes, groups
closer together than the centres of the codes) they miss near ones. So an exact check follows: a query's k-th score
so far bounds what it may have missed, and the cells that could hold better by their radius or their longest vector
are compared with it in double precision. What beats the k-th is added. The answer is that of a comparison of all.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those whose length is not the most common one (the smaller of equals) or whose vec_id is null; equal
scores go to the smaller vec_id; a repeated vec_id counts once, with its smallest vector; with fewer than
k other vectors, all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

#: Vectors that the fit sees at most (those with the smallest hash of their id) and its rounds.
FIT, ROUNDS = 8192, 6
#: Weight of the residual along the vector, relative to the part across it.
PARALLEL = 4.0
#: Vectors and queries in a block, at most about, and candidates reranked for a query: in a block of ROW_BLOCK so
#: many, in smaller ones in proportion, and AT_LEAST.
ROW_BLOCK, QUERY_BLOCK, RERANK, AT_LEAST = 8192, 4096, 200, 64
#: Cells at least, vectors of the sample for each cell beyond these, rounds of the fit, queries of the sample that
#: measure, and the share of near vectors that cells may miss.
CELLS, CELL_SAMPLE, CELL_ROUNDS, PROBED, MISSED = 16, 32, 8, 512, 0.01
#: Scores held at once, and pairs whose products are summed at once.
SCORES_AT_ONCE, PAIRS_AT_ONCE = 1 << 21, 1 << 16
#: Vectors and queries in a block of the check, at most about.
CHECK_BLOCK = 32768


class Cells:
    """Centres of the coarse partition, and how many cells a query visits."""

    def __init__(self, centres: np.ndarray, visits: int):
        self.centres, self.visits = centres, visits

    @classmethod
    def fit(cls, sample: np.ndarray, k: int = 20, n: int = 0) -> Cells:
        """Cells for n vectors, from a sample of them in random order."""
        random = np.random.default_rng(29)
        measure, x = sample[: len(sample) // 2], sample[len(sample) // 2 :]
        many = max(CELLS, min(n // ROW_BLOCK, len(sample) // CELL_SAMPLE))
        centres = x[random.permutation(len(x))[:many]].copy()
        for _ in range(CELL_ROUNDS):
            own = cls(centres, 1).of(x)
            sizes = np.bincount(own, minlength=len(centres))
            for d in range(x.shape[1]):
                sums = np.bincount(own, x[:, d], len(centres))
                centres[sizes > 0, d] = sums[sizes > 0] / sizes[sizes > 0]
        cells = cls(centres, len(centres))
        asked = measure[:PROBED]
        scores = asked @ measure.T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : max(0, min(k, len(measure) - 1))]
        turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(turn[np.arange(len(asked))[:, None], cells.of(measure)[near]].ravel())
        if len(needed):
            cells.visits = int(needed[min(len(needed) - 1, int(np.ceil((1 - MISSED) * len(needed))) - 1)]) + 1
        return cells

    def of(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * (x @ self.centres.T)).argmin(1)

    def visited(self, queries: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of cells that the queries visit, and these cells, which hold so many vectors at least, if there are."""
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(1) + 1
        many = np.minimum(np.maximum(enough, self.visits), len(self.centres))
        return many, order[np.arange(len(self.centres)) < many[:, None]]


class Quantiser:
    """centres: pairs x 16 x 2."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        """x with dimensions added up to a multiple of four."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))

    @classmethod
    def fit(cls, x: np.ndarray) -> Quantiser:
        x = cls.padded(x)
        random = np.random.default_rng(17)
        pairs = x.reshape(len(x), -1, 2)
        pick = random.permutation(len(x))[np.arange(16) % len(x)]
        q = cls(pairs[pick].transpose(1, 0, 2) + random.normal(0, 1e-3 * (x.std() + 1e-12), (pairs.shape[1], 16, 2)))
        for _ in range(5):  # plain rounds give the start
            q._move(pairs, q.encode(x, sweeps=0), None)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(pairs.shape)
        for _ in range(ROUNDS):
            q._move(pairs, q.encode(x), unit)
        return q

    def _move(self, pairs: np.ndarray, codes: np.ndarray, unit: np.ndarray | None) -> None:
        """Move each centre to the least loss of the vectors coded by it, the other pairs held."""
        n, m, _ = pairs.shape
        if unit is not None:
            residual = pairs - self.centres[np.arange(m), codes]
            along = (residual * unit).sum(2)
            whole = along.sum(1)
        for j in range(m):
            own = codes[:, j]
            if unit is None:
                count = np.bincount(own, minlength=16)
                sums = np.stack([np.bincount(own, pairs[:, j, d], 16) for d in (0, 1)], 1)
                self.centres[j, count > 0] = sums[count > 0] / count[count > 0, None]
                continue
            u, rest = unit[:, j], whole - along[:, j]
            left = np.eye(2) + (PARALLEL - 1) * u[:, :, None] * u[:, None, :]
            right = (left @ pairs[:, j, :, None])[:, :, 0] + (PARALLEL - 1) * u * rest[:, None]
            a = np.stack([np.bincount(own, left[:, r, c], 16) for r in (0, 1) for c in (0, 1)], 1).reshape(16, 2, 2)
            b = np.stack([np.bincount(own, right[:, r], 16) for r in (0, 1)], 1)
            some = np.linalg.det(a) > 1e-9
            self.centres[j, some] = np.linalg.solve(a[some], b[some][:, :, None])[:, :, 0]
            fresh = ((pairs[:, j] - self.centres[j, own]) * u).sum(1)
            whole += fresh - along[:, j]

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres on."""
        x = self.padded(x)
        n, m = len(x), x.shape[1] // 2
        pairs = x.reshape(n, m, 2)
        apart = ((pairs[:, :, None, :] - self.centres[None]) ** 2).sum(3)
        codes = apart.argmin(2)
        if not sweeps:
            return codes
        unit = pairs / np.linalg.norm(x, axis=1)[:, None, None]
        along = ((pairs[:, :, None, :] - self.centres[None]) * unit[:, :, None, :]).sum(3)
        rows = np.arange(n)
        whole = along[rows[:, None], np.arange(m), codes].sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = whole - along[rows, j, codes[:, j]]
                loss = apart[:, j] + (PARALLEL - 1) * (along[:, j] ** 2 + 2 * along[:, j] * rest[:, None])
                codes[:, j] = loss.argmin(1)
                whole = rest + along[rows, j, codes[:, j]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes in a byte."""
        codes = self.encode(x).astype(np.uint8)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: the score that each byte value adds."""
        q = self.padded(queries).reshape(len(queries), -1, 2)
        four_bit = np.einsum("qmd,mcd->qmc", q, self.centres).astype(np.float32)
        return (four_bit[:, ::2, :, None] + four_bit[:, 1::2, None, :]).reshape(len(queries), -1, 256)


def inner_products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Products of row pairs, summed in the order of the dimensions, so that equal vectors give equal products."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * queries[:, d]
    return out


def scan(quantiser: Quantiser, codes: np.ndarray, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best rows of a block for each query; rows are in order of their ids."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, SCORES_AT_ONCE // max(1, len(rows)))
    keep = min(len(rows), max(-(-RERANK * len(rows) // ROW_BLOCK), AT_LEAST, 2 * k) + 1)
    for a in range(0, len(queries), step):
        tables = quantiser.tables(queries[a : a + step])
        scores = np.zeros((len(tables), len(rows)), np.float32)
        for j in range(codes.shape[1]):
            scores += np.take(tables[:, j], codes[:, j], axis=1)
        edge = np.partition(scores, len(rows) - keep, axis=1)[:, len(rows) - keep, None]
        able = scores >= edge
        for i in np.flatnonzero(able.sum(1) > 2 * keep):  # many equal codes: the smaller ids of those at the edge
            able[i, np.flatnonzero(scores[i] == edge[i])[keep:]] = False
        asks, some = np.nonzero(able)
        other = ids[some] != query_ids[a + asks]
        asks, some = asks[other], some[other]
        exact = inner_products(rows[some], queries[a + asks])
        order = np.lexsort((some, -exact, asks))
        asks, some, exact = asks[order], some[order], exact[order]
        best = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
        out.append((query_ids[a + asks[best]], ids[some[best]], exact[best]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def slack(dimensions: int) -> float:
    """How far two ways of summing a product may be apart, relative to the product of the lengths, with room to spare."""
    return 4 * (dimensions + 2) * np.finfo(np.float64).eps


def may_hold(queries: np.ndarray, least: np.ndarray, centres: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """queries x cells: whether a cell of this radius, whose vectors are so long at most, may hold a score of least or more."""
    length = np.linalg.norm(queries, axis=1)[:, None]
    bound = np.minimum(queries @ centres.T + length * radius, length * longest)
    room = slack(queries.shape[1]) * length * (np.linalg.norm(centres, axis=1) + radius)
    return ~(bound < least[:, None] - room)


def check(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the rows before (least, last) in each query's order, the k best; rows are in order of their ids."""
    # Of equal rows the first k + 1 have k that come before all others, whichever is the query's own.
    _, same = np.unique(rows.view(f"V{rows.dtype.itemsize * rows.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    turn = np.arange(len(rows)) - np.searchsorted(same[order], same[order])
    first = np.sort(order[turn <= k])
    rows, ids = rows[first], ids[first]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, SCORES_AT_ONCE // max(1, len(rows)))
    room = slack(rows.shape[1]) * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0)
    for a in range(0, len(queries), step):
        asks, some = np.nonzero(~(queries[a : a + step] @ rows.T < (least - room)[a : a + step, None]))
        asks += a
        exact = np.concatenate([np.zeros(0), *(inner_products(rows[some[b : b + PAIRS_AT_ONCE]], queries[asks[b : b + PAIRS_AT_ONCE]]) for b in range(0, len(asks), PAIRS_AT_ONCE))])
        better = ((exact > least[asks]) | (exact == least[asks]) & (ids[some] < last[asks])) & (ids[some] != query_ids[asks])
        asks, some, exact = asks[better], some[better], exact[better]
        order = np.lexsort((some, -exact, asks))
        asks, some, exact = asks[order], some[order], exact[order]
        best = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
        out.append((query_ids[asks[best]], ids[some[best]], exact[best]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the vectors that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def search(embeddings: DataFrame, is_query: Column, k: int = 20, fit: int = FIT) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors of every vector that is_query (on vec_id) picks."""
    spark = embeddings.sparkSession
    common.prepare(spark)
    rows = common.stored(valid(embeddings))
    n = rows.count()
    if rows.where(is_query).isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit).collect()
    fitted = np.array([r["vector"] for r in sample], np.float64)
    quantiser, cells = Quantiser.fit(fitted), Cells.fit(fitted, k, n)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                own = cells.of(x)
                columns = [batch.column("vec_id"), batch.column("asks"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in quantiser.packed(x)], pa.binary()), pa.array(own.astype(np.int32))]
                columns += [pa.array(np.linalg.norm(x - cells.centres[own], axis=1)), pa.array(np.linalg.norm(x, axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "asks", "vector", "codes", "cell", "apart", "length"])

    index = rows.withColumn("asks", F.coalesce(is_query, F.lit(False))).mapInArrow(coded, "vec_id long, asks boolean, vector binary, codes binary, cell int, apart double, length double")
    index = common.stored(index)
    common.discard(rows)

    def by_cell(frame: DataFrame, *of: Column) -> list[np.ndarray]:
        """Aggregates of each cell, 0 where it has no rows."""
        out = [np.zeros(len(cells.centres)) for _ in of]
        for r in frame.groupBy("cell").agg(*of).collect():  # a row for each cell
            for values, value in zip(out, r[1:]):
                values[r["cell"]] = value
        return out

    def counted(frame: DataFrame) -> np.ndarray:
        return by_cell(frame, F.count(F.lit(1)))[0].astype(np.int64)

    sizes, radius, longest = by_cell(index, F.count(F.lit(1)), F.max("apart"), F.max("length"))
    sizes = sizes.astype(np.int64)

    def lists(many: np.ndarray, visited: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(visited.astype(np.int32)))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                visited = lists(*cells.visited(_matrix(batch.column("vector")), sizes, k + 1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), visited], ["vec_id", "vector", "visited"])

    def blocks_of(counts: np.ndarray, size: int) -> Column:
        """By a row's cell, into how many blocks of so many rows the cell's are cut; 0 where there are none."""
        return F.get(F.array(*(F.lit(int(c)) for c in -(-counts // size))), F.col("cell"))

    def copied(rows: DataFrame, blocks: Column, name: str) -> DataFrame:
        """A copy of each row for each of its cell's blocks of the other side, if there are any."""
        return rows.where(blocks > 0).withColumn(name, F.explode(F.sequence(F.lit(0), blocks - 1)))

    def met(visits: DataFrame, columns: list[str], row_size: int, query_size: int, tile: Callable[[pa.Table, pa.Table], tuple[np.ndarray, ...]]) -> DataFrame:
        """What tile gives for the blocks of a cell and of the queries that visit it, both in order of their ids."""
        visits = visits.withColumn("cell", F.explode("visited")).drop("visited")
        row_blocks, query_blocks = blocks_of(sizes, row_size), blocks_of(counted(visits.select("cell")), query_size)
        right = copied(visits, row_blocks, "r").withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), query_blocks).cast("int"))
        left = copied(index.select("vec_id", "cell", *columns), query_blocks, "q").withColumn("r", F.pmod(F.xxhash64("vec_id"), row_blocks).cast("int"))

        def both(block: pa.Table, asked: pa.Table) -> pa.Table:
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if block.num_rows and asked.num_rows:
                got = tile(block.sort_by("vec_id"), asked.sort_by("vec_id"))
            return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

        return left.groupBy("cell", "r", "q").cogroup(right.groupBy("cell", "r", "q")).applyInArrow(both, "query_id long, vec_id long, score double")

    def scanned(block: pa.Table, asked: pa.Table) -> tuple[np.ndarray, ...]:
        codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(block.num_rows, -1)
        return scan(quantiser, codes, _matrix(block.column("vector")), block.column("vec_id").to_numpy(), _matrix(asked.column("vector")), asked.column("vec_id").to_numpy(), k)

    def ranked(found: DataFrame) -> DataFrame:
        # k rows of each block for each query: the ranking is spread by query.
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asking = index.where("asks").select("vec_id", "vector")
    found = met(asking.mapInArrow(visiting, "vec_id long, vector binary, visited array<int>"), ["vector", "codes"], ROW_BLOCK, QUERY_BLOCK, scanned)
    found = common.stored(ranked(found))

    def doubting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                open_ = may_hold(_matrix(batch.column("vector")), batch.column("least").to_numpy(), cells.centres, radius, longest) & (sizes > 0)
                visited = lists(open_.sum(1), np.nonzero(open_)[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, visited], [*batch.schema.names, "visited"])

    def checked(block: pa.Table, asked: pa.Table) -> tuple[np.ndarray, ...]:
        return check(_matrix(block.column("vector")), block.column("vec_id").to_numpy(), _matrix(asked.column("vector")), asked.column("vec_id").to_numpy(), asked.column("least").to_numpy(), asked.column("last").to_numpy(), k)

    # With fewer than k found, nothing is ruled out.
    kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("asker"), F.col("score").alias("least"), F.col("vec_id").alias("last"))
    doubts = asking.join(kth, F.col("vec_id") == F.col("asker"), "left")
    doubts = doubts.select("vec_id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.coalesce("last", F.lit((1 << 63) - 1)).alias("last"))
    missed = met(doubts.mapInArrow(doubting, "vec_id long, vector binary, least double, last long, visited array<int>"), ["vector"], CHECK_BLOCK, CHECK_BLOCK, checked)
    # The check finds those before the k-th again, with the same scores.
    return ranked(found.select("query_id", "vec_id", "score").union(missed).repartition("query_id").dropDuplicates(["query_id", "vec_id"]))
