from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import anisotropic_search as search


def brute(rows, k=20):
    good = {i: np.array(v, float) for i, v in rows.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for a, i in enumerate(ids):
        if i % 20 == 0:
            scores = x @ x[a]
            scores[a] = -np.inf
            out[int(i)] = [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores))[:k] if j != a]
    return out


def found(df, **options):
    out = {}
    for r in sorted(search.search(df, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores_on_the_small_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    want, got = brute(rows), found(df)
    assert set(got) == set(want)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.95
    for q, near in got.items():
        assert all(abs(s - np.dot(np.array(rows[q], float), np.array(rows[v], float))) < 1e-9 for v, s in near)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_equal_vectors_have_equal_scores_wherever_they_lie():
    random = np.random.default_rng(11)
    for kind in (np.float64, np.float32):
        distinct = random.normal(size=(40, 64)).astype(kind).astype(np.float64)
        for n in (50, 333, 900):
            pick = random.integers(0, 40, n)
            rows, ids = distinct[pick], np.arange(n) * 3
            quantiser = search.Quantiser.fit(rows)
            asked = np.arange(0, n, 7)
            got = search.scan(quantiser, quantiser.packed(rows), rows, ids, rows[asked], ids[asked], 20)
            products = search.inner_products(np.repeat(distinct, 40, 0), np.tile(distinct, (40, 1))).reshape(40, 40)
            for a in asked[:60]:
                own = got[0] == ids[a]
                order = np.lexsort((ids, -products[pick, pick[a]]))
                want = [j for j in order if j != a][:20]
                if len(set(got[1][own]) & set(ids[want])) == 20:  # nothing missed: then the order is exact
                    assert got[1][own].tolist() == ids[want].tolist()
                scores = got[2][own]
                for i in range(1, len(scores)):
                    assert scores[i] < scores[i - 1] or scores[i] == scores[i - 1] and got[1][own][i] > got[1][own][i - 1]


def test_recall_of_full_blocks():
    """Blocks of ROW_BLOCK vectors without any structure, at the production parameters."""
    random = np.random.default_rng(12)
    rows = random.normal(size=(search.ROW_BLOCK, 64)) * random.lognormal(0, 0.2, (search.ROW_BLOCK, 1))
    quantiser = search.Quantiser.fit(rows[:4096])
    asked = np.arange(0, len(rows), 64)
    got = search.scan(quantiser, quantiser.packed(rows), rows, np.arange(len(rows)), rows[asked], asked, 20)
    exact = rows[asked] @ rows.T
    exact[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([len(set(got[1][got[0] == a]) & set(want[i])) / 20 for i, a in enumerate(asked)]) >= 0.95


def test_cells_are_pruned_where_there_are_clusters():
    random = np.random.default_rng(13)
    centres = random.normal(size=(16, 32)) * 3
    clustered = centres[random.integers(0, 16, 4000)] + random.normal(size=(4000, 32)) * 0.3
    assert search.Cells.fit(clustered).visits <= 6
    loose = search.Cells.fit(random.normal(size=(4000, 32)))
    assert 6 < loose.visits <= 16
    assert search.Cells.fit(random.normal(size=(3, 32))).visits <= 3 and search.Cells.fit(np.ones((1, 4))).visits == 1


def test_cells_grow_with_the_vectors(monkeypatch):
    random = np.random.default_rng(14)
    sample = random.normal(size=(2048, 16))
    count = {n: len(search.Cells.fit(sample, n=n).centres) for n in (2048, 40 * search.ROW_BLOCK, 10**9)}
    assert count == {2048: search.CELLS, 40 * search.ROW_BLOCK: 40, 10**9: 2048 // search.CELL_SAMPLE}


def test_recall_with_more_cells_than_the_least(spark, monkeypatch):
    """Clusters, of which one holds a third of all rows, in cells of 64 vectors: most are not visited, recall holds."""
    monkeypatch.setattr(search, "ROW_BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    random = np.random.default_rng(15)
    centres = random.normal(size=(40, 32)) * 2
    x = centres[np.where(random.random(3000) < 0.34, 0, random.integers(0, 40, 3000))] + random.normal(size=(3000, 32)) * 0.3
    fitted = search.Cells.fit(x[random.permutation(3000)], n=3000)
    assert len(fitted.centres) == 46 and fitted.visits <= 23
    want, got = brute(dict(enumerate(x.tolist()))), found(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95
    assert all(len(near) == 20 for near in got.values())


def test_cells_visited_hold_as_many_vectors_as_are_asked_for():
    cells = search.Cells(np.array([[4.0, 0], [3, 0], [2, 0], [1, 0]]), 1)
    sizes = np.array([5, 10, 0, 50])
    for least, want in ((3, [0]), (15, [0, 1]), (16, [0, 1, 2, 3]), (900, [0, 1, 2, 3])):
        many, visited = cells.visited(np.array([[1.0, 0], [-1, 0]]), sizes, least)
        assert visited[: many[0]].tolist() == want and many[1] == (1 if least < 51 else 4)


@pytest.mark.parametrize("kind", ["scales", "tails", "copies"])
def test_nothing_is_missed_where_the_codes_fit_badly(spark, kind, monkeypatch):
    """Vectors whose near ones the scan misses, in one block of queries or many: the check finds them, in order."""
    random = np.random.default_rng(16)
    x = random.normal(size=(3000, 32))
    if kind == "scales":
        x *= 10.0 ** -np.arange(32)
    if kind == "tails":
        x = random.standard_t(1, size=(3000, 32))
    if kind == "copies":
        x = np.round(np.where(random.random((3000, 1)) < 0.5, x[random.integers(0, 3, 3000)], x) * 64) / 64  # exact products
    if kind != "copies":
        monkeypatch.setattr(search, "CHECK_BLOCK", 64)
    want, got = brute(dict(enumerate(x.tolist()))), found(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), fit=300)
    assert {q: [v for v, _ in near] for q, near in got.items()} == {q: [v for v, _ in near] for q, near in want.items()}


def test_the_check_finds_what_comes_before_the_last_found():
    random = np.random.default_rng(18)
    distinct = random.normal(size=(30, 8))
    pick = random.integers(0, 30, 2000)
    rows, ids = distinct[pick], np.arange(2000) * 2
    scores = search.inner_products(np.repeat(rows[:40], 2000, 0), np.tile(rows, (40, 1))).reshape(40, 2000)
    for place in (0, 3, 19, 700):
        orders = [[j for j in np.lexsort((ids, -scores[a])) if j != a] for a in range(40)]
        last = np.array([o[place] for o in orders])
        got = search.check(rows, ids, rows[:40], ids[:40], scores[np.arange(40), last], ids[last], 20)
        for a in range(40):
            own = got[0] == ids[a]
            assert got[1][own].tolist() == ids[orders[a][:place]].tolist()[:20]
            assert got[2][own].tolist() == scores[a][orders[a][:place]].tolist()[:20]
    got = search.check(rows, ids, rows[:2], ids[:2], np.full(2, -np.inf), np.full(2, 1 << 60), 5000)
    assert len(got[0]) == 2 * 1999
    assert [len(g) for g in search.check(rows[:0], ids[:0], rows, ids, scores[0], ids, 20)] == [0, 0, 0]


def test_no_cell_is_left_out_that_may_hold_better():
    random = np.random.default_rng(19)
    for spread in (0.01, 0.3, 3.0):
        centres = random.normal(size=(20, 16))
        of = random.integers(0, 19, 3000)
        x = (centres[of] + random.standard_t(3, (3000, 16)) * spread) * np.where(of < 10, 1, 1e-3)[:, None]
        apart, length = np.linalg.norm(x - centres[of], axis=1), np.linalg.norm(x, axis=1)
        radius, longest = (np.array([v[of == c].max(initial=0) for c in range(20)]) for v in (apart, length))
        scores = x[:200] @ x.T
        least = np.sort(scores, axis=1)[:, -20]
        open_ = search.may_hold(x[:200], least, centres, radius, longest)
        asks, some = np.nonzero(scores >= least[:, None])
        assert open_[asks, of[some]].all()
        assert not open_[:, 19].any() and (spread > 1 or open_.mean() < 0.5)


@pytest.mark.parametrize("cores", [1, 7])
def test_the_number_of_cores_changes_nothing(spark, small, cores, monkeypatch):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    want = found(df)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", cores)
    assert found(df.repartition(cores)) == want


@pytest.mark.parametrize("dims", [3, 8])
def test_blocks_and_long_vectors(spark, monkeypatch, dims):
    monkeypatch.setattr(search, "ROW_BLOCK", 128)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    random = np.random.default_rng(5)
    rows = {i: (random.normal(size=dims) * random.lognormal()).tolist() for i in range(900)}
    want, got = brute(rows), found(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_odd_vectors_and_ties(spark):
    same = [1.0, 0.0, 2.0, 0.0]
    rows = {i: same for i in range(0, 60)} | {100: None, 120: [0.0] * 4, 140: [1.0, None, 0.0, 0.0], 160: [float("nan"), 1.0, 1.0, 1.0], 180: [float("inf"), 1.0, 1.0, 1.0], 200: [1.0, 2.0]}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").union(spark.createDataFrame([(5, same), (None, same)], "vec_id long, embedding array<double>"))
    got = found(df.withColumn("label", F.lit(1)).withColumn("vector", F.lit("clash")))
    assert got == {q: [(v, 5.0) for v in range(60) if v != q][:20] for q in (0, 20, 40)}
    assert found(df.where("vec_id > 300")) == {}
    few = found(df.where("vec_id < 3"))
    assert few == {0: [(1, 5.0), (2, 5.0)]}
    assert found(df.where("vec_id = 0")) == {}
