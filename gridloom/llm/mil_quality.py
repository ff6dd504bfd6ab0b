"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of 64 words. Each passage is encoded by a dense layer over its character
classes, word lengths and repetition; a gated attention (tanh times sigmoid) weighs the passages of a bag,
and the score is a logistic of the weighted sum. Only the documents' labels are known to the fit.

Defined cases: a null or empty text is one empty passage and gets a score; several labels of one document
count as their maximum; rows whose doc_id is null are left out; a doc_id in several rows gives a row each;
without labels of both kinds every score is the smoothed share of label 1; of the rows of a labelled doc_id the
fit sees the one whose features come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

#: Labelled documents that the fit sees at most, and passages of all of them together: the documents with the
#: smallest hashes of their ids, each with all its passages, as far as both bounds go. Scoring takes every passage.
FIT_DOCUMENTS, FIT_PASSAGES = 4000, 50_000
PASSAGE_WORDS, HIDDEN, GATE = 64, 12, 8
KINDS = ("a-z", "A-Z", "0-9", " ", "\n", "!", "?", ".", ",", "|", "#$%&*+=~^", "<>{}[]()/\\@", ":;'\"-_`")

_kind_of = np.full(256, len(KINDS), np.uint8)
for _i, _k in enumerate(KINDS):
    for _c in range(ord(_k[0]), ord(_k[2]) + 1) if len(_k) == 3 and _k[1] == "-" else map(ord, _k):
        _kind_of[_c] = _i
_kind_of[128:] = len(KINDS) + 1
N_KINDS = len(KINDS) + 2
N_FEATURES = N_KINDS + 7


def passages(chunk: common.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a chunk, and the first passage of each text (each has at least one)."""
    starts, ends, ranges = chunk.words()
    counts = np.diff(ranges)
    held = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(held)])
    n = int(first[-1])
    word_at = np.arange(len(starts)) - np.repeat(ranges[:-1], counts)
    of_word = np.repeat(first[:-1], counts) + word_at // PASSAGE_WORDS
    # A byte belongs to the passage of the last word that starts at or before it, within its text.
    opens = np.zeros(len(chunk.data), np.int64)
    head = starts[(word_at % PASSAGE_WORDS == 0) & (word_at > 0)]
    opens[head] += 1
    steps = np.cumsum(opens) if len(opens) else opens
    texts_of = np.repeat(np.arange(chunk.n), np.diff(chunk.bounds))
    before = np.concatenate([[0], steps])[chunk.bounds[:-1]] if len(steps) else np.zeros(chunk.n, np.int64)
    of_byte = first[:-1][texts_of] + steps - before[texts_of]
    kinds = np.bincount(of_byte * N_KINDS + _kind_of[chunk.data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(np.float64)
    size = np.maximum(kinds.sum(1), 1)
    lengths = (ends - starts).astype(np.float64)
    words = np.bincount(of_word, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(of_word, lengths, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, lengths**2, n) / some - mean**2))
    hashes = chunk.word_hashes(starts, ends)
    owner = np.repeat(np.arange(chunk.n), counts)
    order = np.lexsort((hashes, of_word))
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
    twice = np.bincount(of_word[order], again, n) / some
    order = np.lexsort((hashes, owner))
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    echoed = np.bincount(of_word[order], again, n) / some
    capital = np.bincount(of_word, _kind_of[chunk.data[starts]] == 1, n) / some
    whole = np.log1p(counts.astype(np.float64))
    doc_of = np.repeat(np.arange(chunk.n), held)
    return np.column_stack([kinds / size[:, None], mean / 8, spread / 8, twice, echoed, capital, whole[doc_of] / 8, words == 0]), first


@dataclass
class Model:
    """Gated attention over encoded passages; constant is the score where nothing could be learned."""

    weights: dict[str, np.ndarray] | None
    centre: np.ndarray
    scale: np.ndarray
    constant: float

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "bag": bag}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.constant) if self.weights is None else self.forward(x, first)["p"]


def gradient(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the bags, by the weights; bag i is rows first[i]:first[i + 1] of x."""
    w, v = model.weights, model.forward(x, first)
    dz = np.outer((v["p"] - labels) / len(labels), w["c"])
    grad = {"c": v["z"].T @ (v["p"] - labels) / len(labels), "d": np.sum(v["p"] - labels) / len(labels)}
    by_bag = dz[v["bag"]]
    da = (by_bag * v["h"]).sum(1)
    de = v["a"] * (da - np.add.reduceat(v["a"] * da, first[:-1])[v["bag"]])
    grad["w"] = (v["t"] * v["s"]).T @ de
    dt, ds = np.outer(de, w["w"]) * v["s"] * (1 - v["t"] ** 2), np.outer(de, w["w"]) * v["t"] * v["s"] * (1 - v["s"])
    grad["V"], grad["U"] = v["h"].T @ dt, v["h"].T @ ds
    dh = (v["a"][:, None] * by_bag + dt @ w["V"].T + ds @ w["U"].T) * (1 - v["h"] ** 2)
    grad["W"], grad["b"] = v["x"].T @ dh, dh.sum(0)
    return grad


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = 300, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Train by Adam on all the bags at once; the same bags give the same model."""
    ones = float(labels.sum())
    constant = (ones + 1) / (len(labels) + 2)
    if not bags or ones in (0, len(labels)):
        return Model(None, np.zeros(N_FEATURES), np.ones(N_FEATURES), constant)
    x = np.concatenate(bags)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    random = np.random.default_rng(7)
    shapes = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s) if s and k not in "b" else np.zeros(s) for k, s in shapes.items()}
    model = Model(weights, x.mean(0), np.maximum(x.std(0), 1e-3), constant)
    first_moment, second_moment = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        w = model.weights
        grad = gradient(model, x, first, labels)
        for k in shapes:
            g = grad[k] + decay * w[k]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.999 * second_moment[k] + 0.001 * g**2
            w[k] = w[k] - rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for chunk in common.chunks(batch.column(1)):
            x, first = passages(chunk)
            bags += [x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(chunk.n)]
        sizes = pa.array([len(b) // (4 * N_FEATURES) for b in bags], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary()), sizes], ["doc_id", "label", "bag", "size"])


def train(documents: DataFrame, labels: DataFrame, column: str = "quality", limit: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most limit labelled documents outside the held-out fold, those with the smallest hash of their id."""
    docs = common.texts(documents)
    common.prepare(docs.sparkSession)
    label = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(column).cast("double").alias("label")).where("label_id is not null and label is not null")
    label = label.where(~common.held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = label.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)  # bounded by limit, so it may be broadcast
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
    bags = common.stored(rows.mapInArrow(_bags, "doc_id long, label double, bag binary, size long").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("bag").alias("bag"), F.min_by("size", "bag").alias("size")))
    up_to = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = bags.select("doc_id", F.sum("size").over(up_to).alias("total"))  # limit rows at most, without their bags
    sizes = sizes.where(F.col("total") <= FIT_PASSAGES).select("doc_id")
    got = bags.join(F.broadcast(sizes), "doc_id").toPandas().sort_values("doc_id")
    common.discard(bags)
    return fit([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for b in got["bag"]], (got["label"].to_numpy(float) > 0.5).astype(float))


def score(documents: DataFrame, model: Model, keep: str = "") -> DataFrame:
    """doc_id and score of every document; with keep, a SQL schema of further columns, those as well."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scores(*passages(chunk)) for chunk in common.chunks(batch.column("text"))]
            scores = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            names = [n for n in batch.schema.names if n != "text" or keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], [*names, "score"])

    common.prepare(documents.sparkSession)
    if keep:
        return documents.mapInArrow(scored, f"{keep}, score double")
    return common.texts(documents).mapInArrow(scored, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= threshold) of every document."""
    got = score(documents, train(documents, labels))
    return got.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
