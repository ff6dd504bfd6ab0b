"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The vector space is spanned by the terms that tell the labels apart (log-likelihood ratio over a bounded
sample of labelled documents); their document frequencies come from all documents. The sample's vectors
are the examples. Their inverted index keeps, for each term and block of examples, the largest weight in
the block: the sum of these maxima bounds every cosine in the block, and blocks whose bound is below the
k-th best cosine so far are skipped, so the k nearest are exact. Votes weighted by cosine, smoothed
towards the share of label 1 among examples, give the score; the neighbours are the evidence.

Defined cases: texts without any of the terms (empty and null ones too) get the smoothed share of label 1
among the sample's texts without them; several labels of one document count as their maximum; rows whose
doc_id is null are left out; a doc_id in several rows gives a row each; equal cosines go to the smaller
doc_id; without labels of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

#: Labelled documents that the fit sees at most (those with the smallest hash of their id), and how many of
#: these are judged by the others to calibrate the scores.
FIT_DOCUMENTS, CALIBRATE = 20_000, 4000
#: Documents of the sample that must hold a term. Of n such terms, those whose log-likelihood ratio is
#: at least 2 ln n - ln(pi ln n) are kept: by chance that is about one term, whatever the size of the sample.
LEAST_DOCUMENTS = 3
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 25, 64, 0.5


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct word hashes of each text and how often it holds them; edge punctuation belongs to no word."""
    for chunk in common.chunks(column):
        starts, ends, ranges = trimmed(chunk)
        hashes = chunk.word_hashes(starts, ends)
        for a, b in zip(ranges[:-1], ranges[1:], strict=True):
            yield np.unique(hashes[a:b], return_counts=True)


_letter = np.zeros(256, bool)
_letter[128:] = True
for _a, _b in ("az", "AZ", "09"):
    _letter[ord(_a) : ord(_b) + 1] = True


def trimmed(chunk: common.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, digits and non-ASCII bytes: starts, ends, and each text's range of them."""
    solid = _letter[chunk.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[chunk.bounds] = True
    before = np.concatenate([[False], solid])[: len(solid)] & ~edge[: len(solid)]
    after = np.concatenate([solid[1:], [False]])[: len(solid)] & ~edge[1:]
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, chunk.bounds)


def _ratio(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of a term held by a of n1 and b of n0 documents."""

    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p), 0) + np.where(n - k > 0, (n - k) * np.log(1 - p), 0)

    both = (a + b) / (n1 + n0)
    return 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, both) - part(b, n0, both))


@dataclass
class Index:
    """Examples as a block-max inverted index over sorted terms."""

    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    pointers: np.ndarray  # postings of term t in block b: pointers[t, b]:pointers[t, b + 1]
    example: np.ndarray
    weight: np.ndarray
    maxima: np.ndarray  # terms x blocks
    share: float  # of label 1 among the examples
    without: float  # score of texts without any term
    slope: float = 1.0  # of the calibration, over the log-odds of the votes
    shift: float = 0.0

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that a text holds, and their normalised weights."""
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        good = self.terms[at] == words
        at = at[good]
        w = (1 + np.log(counts[good])) * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (above 0) and these cosines, largest first, ties to the smaller id."""
        bounds = w @ self.maxima[at]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        head = max(1, -(-2 * k // BLOCK))
        sums = self._sums(at, w, order[:head])
        least = np.sort(sums)[-k] if len(sums) >= k else 0.0
        rest = order[head:]
        rest = rest[bounds[rest] >= least - 1e-12]
        if len(rest):
            sums += self._sums(at, w, rest)
        some = np.flatnonzero(sums > 0)
        if len(some) > k:
            some = some[sums[some] >= np.partition(sums[some], -k)[-k]]
        some = some[np.lexsort((some, -sums[some]))[:k]]  # examples are in order of their ids
        return some, sums[some]

    def _sums(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of the examples in some blocks, from the postings of those blocks alone."""
        a, b = self.pointers[np.ix_(at, blocks)], self.pointers[np.ix_(at, blocks + 1)]
        sizes = (b - a).ravel()
        ends = np.cumsum(sizes)
        own = np.repeat(a.ravel() - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.example[own], self.weight[own] * np.repeat(np.repeat(w, len(blocks)), sizes), minlength=len(self.ids))

    def votes(self, best: np.ndarray, cosines: np.ndarray) -> float:
        """Log-odds of label 1 by the neighbours' votes, weighted by squared cosine."""
        weight = cosines**2
        ones = (weight * self.labels[best]).sum() + PRIOR_WEIGHT * self.share
        return float(np.log(ones / (weight.sum() + PRIOR_WEIGHT - ones)))

    def judge(self, words: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Score, and the neighbours behind it with their cosines."""
        at, w = self.vector(words, counts) if len(self.terms) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(at):
            return self.without, np.zeros(0, np.int64), np.zeros(0)
        best, cosines = self.nearest(at, w, NEIGHBOURS)
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.votes(best, cosines) + self.shift, -30, 30)))), best, cosines

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit slope and shift so that the odds hold for examples judged without themselves; vectors as indexed."""
        odds = np.zeros(len(vectors))
        for i, (at, w) in enumerate(vectors):
            best, cosines = self.nearest(at, w, NEIGHBOURS + 1)
            other = best != i
            odds[i] = self.votes(best[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS])
        own = self.labels[: len(vectors)]
        if 0 < own.sum() < len(own):
            self.slope, self.shift = _logistic(odds, own)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and intercept of a logistic regression by Newton's method, held near (1, 0) by a weak prior."""
    w, centre = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + (w - centre)
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def build(ids: list[int], labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, df: np.ndarray, n: int) -> Index:
    """Index the examples that hold a term; df and n are counts over all documents."""
    idf = np.log((n + 1) / (df + 0.5))
    index = Index(terms, np.maximum(idf, 1e-3), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(terms), 2), np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(terms), 1)), (labels.sum() + 1) / (len(labels) + 2), 0.0)
    made = [index.vector(*v) if len(terms) else (np.zeros(0, np.int64), np.zeros(0)) for v in vectors]
    full = np.array([len(at) > 0 for at, _ in made], bool)
    index.without = float((labels[~full].sum() + 1) / ((~full).sum() + 2)) if len(terms) else float(index.share)
    keep = sorted(np.flatnonzero(full).tolist(), key=lambda i: ids[i])
    if keep:
        at = np.concatenate([made[i][0] for i in keep])
        w = np.concatenate([made[i][1] for i in keep])
        example = np.repeat(np.arange(len(keep)), [len(made[i][0]) for i in keep])
        order = np.lexsort((example, at))
        index.ids, index.labels = np.array([ids[i] for i in keep], np.int64), labels[keep]
        index.example, index.weight = example[order], w[order]
        blocks = len(keep) // BLOCK + 1
        index.pointers = np.searchsorted((at * blocks + example // BLOCK)[order], np.arange(len(terms))[:, None] * blocks + np.arange(blocks + 1))
        index.maxima = np.zeros((len(terms), blocks))
        np.maximum.at(index.maxima, (at, example // BLOCK), w)
        index.calibrate([made[i] for i in keep[:CALIBRATE]])
    return index


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the terms of this task's sampled texts: in how many of each label they are."""
    ones, zeros = Counter(), Counter()
    for batch in batches:
        for label, (words, _) in zip(batch.column("label").to_pylist(), _words(batch.column("text")), strict=True):
            (ones if label > 0.5 else zeros).update(words.view(np.int64).tolist())
    every = list(ones.keys() | zeros.keys())
    yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), pa.array([ones[t] for t in every], pa.int64()), pa.array([zeros[t] for t in every], pa.int64())], ["term", "ones", "zeros"])


def _held(terms: np.ndarray):
    """The terms that each text holds, as bytes of their numbers and counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, counts in _words(batch.column("text")):
                good = np.isin(words, terms, assume_unique=True)
                out.append(np.concatenate([words[good], counts[good].astype(np.uint64)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "held"])

    return rows


def _frequencies(terms: np.ndarray):
    """Over this task's texts: how many there are (term null), and how many hold each term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for chunk in common.chunks(batch.column("text")):
                starts, ends, ranges = trimmed(chunk)
                hashes = chunk.word_hashes(starts, ends)
                at = np.searchsorted(terms, hashes)
                good = terms[np.minimum(at, len(terms) - 1)] == hashes if len(terms) else np.zeros(len(hashes), bool)
                owner = np.repeat(np.arange(chunk.n), np.diff(ranges))[good]
                df += np.bincount(np.unique(owner * (len(terms) + 1) + at[good]) % (len(terms) + 1), minlength=len(terms) + 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None, *some.tolist()], pa.int64()), pa.array([n, *df[some].tolist()], pa.int64())], ["term", "n"])

    return rows


def train(documents: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = FIT_DOCUMENTS) -> Index:
    """Index at most limit labelled documents outside the held-out fold; frequencies are over all documents."""
    docs = common.texts(documents)
    common.prepare(docs.sparkSession)
    label = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(column).cast("double").alias("label")).where("label_id is not null and label is not null")
    label = label.where(~common.held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = label.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)  # bounded by limit, so it may be broadcast
    sample = common.stored(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label").dropDuplicates(["doc_id"]))
    kinds = {bool(r[0] > 0.5): r[1] for r in sample.groupBy((F.col("label") > 0.5).cast("double").alias("l")).count().collect()}
    n1, n0 = kinds.get(True, 0), kinds.get(False, 0)
    terms = np.zeros(0, np.uint64)
    if n1 and n0:
        counts = sample.mapInArrow(_sample_words, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        counts = common.stored(counts.where(F.col("ones") + F.col("zeros") >= LEAST_DOCUMENTS))
        log_n = np.log(max(3, counts.count()))
        least = 2 * log_n - np.log(np.pi * log_n)

        def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"term": b["term"], "ratio": _ratio(b["ones"].to_numpy(float), b["zeros"].to_numpy(float), n1, n0)})

        best = counts.mapInPandas(rated, "term long, ratio double").where(F.col("ratio") >= float(least)).collect()  # terms of the sample, which limit bounds
        terms = np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))
    frequencies = docs.mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
    df = {r["term"]: r["n"] for r in frequencies}
    held = sample.mapInArrow(_held(terms), "doc_id long, label double, held binary").orderBy("doc_id").collect()  # limit rows at most, of selected terms
    vectors = [tuple(np.frombuffer(r["held"], np.uint64).reshape(2, -1)) for r in held]
    vectors = [(words, counts.astype(float)) for words, counts in vectors]
    return build([r["doc_id"] for r in held], np.array([float(r["label"] > 0.5) for r in held]), vectors, terms, np.array([df.get(i, 0) for i in range(len(terms))], float), df.get(None, 0))


def score(documents: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """doc_id, score, and the evidence nearest examples with their cosines, of every document."""
    docs = common.texts(documents)
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by FIT_DOCUMENTS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.judge(*found) for found in _terms_of(batch.column("text"), own.terms)]
            near = [own.ids[b[:evidence]].tolist() for _, b, _ in got]
            cosines = [c[:evidence].tolist() for _, _, c in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "examples", "cosines"])

    return docs.mapInArrow(rows, "doc_id long, score double, examples array<long>, cosines array<double>")


def _terms_of(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _words, for the words among the terms alone."""
    none = np.zeros(0, np.uint64), np.zeros(0)
    for chunk in common.chunks(column):
        if not len(terms):
            yield from (none for _ in range(chunk.n))
            continue
        starts, ends, ranges = trimmed(chunk)
        hashes = chunk.word_hashes(starts, ends)
        good = np.flatnonzero(terms[np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)] == hashes)
        cuts = np.searchsorted(good, ranges)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(hashes[good[a:b]], return_counts=True) if b > a else none


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score >= threshold) and the evidence of every document."""
    got = score(documents, train(documents, labels))
    return got.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "examples", "cosines")
