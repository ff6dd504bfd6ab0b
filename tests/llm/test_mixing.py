from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing


def plan(spark, totals, **options):
    rows = spark.createDataFrame([(f"={k}", v, 10) for k, v in totals.items()], "mix string, total long, documents long")
    return {r.mix[1:]: r for r in mixing.weights(rows, **options).collect()}


def test_exponent_meets_the_repetition_limit(spark):
    totals = {"a": 9000, "b": 900, "c": 90}
    got = plan(spark, totals, repetition_limit=3.0)
    exponent = got["a"].exponent
    assert math.isclose((90 / 9000) ** (exponent - 1), 3.0, rel_tol=1e-9)
    whole = sum(v**exponent for v in totals.values())
    for k, v in totals.items():
        assert math.isclose(got[k].weight, v**exponent / whole, rel_tol=1e-9)
        assert math.isclose(got[k].repeats, (v / 9000) ** (exponent - 1), rel_tol=1e-9)
    assert {r.exponent for r in plan(spark, totals, repetition_limit=1000.0).values()} == {0.0}


def test_exponent_meets_the_entropy(spark):
    got = plan(spark, {"a": 9000, "b": 900, "c": 90}, entropy=0.9)
    assert math.isclose(-sum(r.weight * math.log(r.weight) for r in got.values()), 0.9, rel_tol=1e-6)
    assert {r.exponent for r in plan(spark, {"a": 90, "b": 90}, entropy=0.1).values()} == {1.0}


def test_odd_totals(spark):
    got = plan(spark, {"a": 0, "b": 0})
    assert {(r.weight, r.repeats) for r in got.values()} == {(0.0, 1.0)}
    got = plan(spark, {"a": 0, "b": 10})
    assert (got["a"].weight, got["a"].repeats, got["b"].weight) == (0.0, 1.0, 1.0)
    assert plan(spark, {}) == {}


def test_documents_of_a_mixture(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 10 == 1, "small").otherwise("mid").alias("source"))
    texts = {r.doc_id: r for r in rows.collect()}
    tokens = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in texts.items()}
    got = mixing.mixture(rows, repetition_limit=2.5).collect()
    seen = {}
    for r in got:
        assert r.n_tokens == tokens[r.doc_id] and 0 <= r.slot <= 1.0001
        seen.setdefault(r.doc_id, []).append(r.epoch)
    assert set(seen) == set(texts)  # every document at least once
    assert all(sorted(e) == list(range(len(e))) for e in seen.values())
    totals, weights = {}, {r.source: r.weight for r in got}
    for r in got:
        totals[r.source] = totals.get(r.source, 0) + r.n_tokens
    for source, w in weights.items():
        assert abs(totals[source] / sum(totals.values()) - w) < 0.05
    again = {(r.doc_id, r.epoch, r.slot) for r in mixing.mixture(rows.repartition(3), repetition_limit=2.5).collect()}
    assert again == {(r.doc_id, r.epoch, r.slot) for r in got}
    copies = {r.doc_id: r["count"] for r in mixing.mixed(rows, repetition_limit=2.5).groupBy("doc_id").count().collect()}
    assert copies == {d: len(e) for d, e in seen.items()}


def test_a_budget_takes_part_of_an_epoch(make):
    rows = make([(i, "one two three four") for i in range(200)])
    got = mixing.mixture(rows, budget=400).collect()
    assert len(got) == 100 and {r.epoch for r in got} == {0}


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "c"), (None, "lost")]])
def test_odd_rows(make, rows):
    df = make(rows).withColumn("source", F.when(F.col("doc_id") > 1, F.col("source")))
    got = sorted((r.doc_id, r.n_tokens, r.source) for r in mixing.mixture(df).collect())
    assert got == [(1, 0, None), (2, 0, "s"), (3, 1, "s"), (3, 2, "s")]
    kept = mixing.mixed(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3, 3]
    assert mixing.mixture(df.where("doc_id > 7")).collect() == []


def test_columns_of_any_name_come_through(make):
    docs = make([(i, f"some words here {i}") for i in range(9)])
    for name in ("_doc", "_copies", "_mix", "_version", "mix", "version", "block", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and got.count() >= 9
    assert {r._copies for r in got.collect()} == {"_copies"}


def test_groups_of_blocks_keep_every_slot_apart(make, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "GROUP", 3)
    docs = make([(i, "w " * (i % 7 + 1)) for i in range(300)])
    rows = mixing.mixture(docs, repetition_limit=1.0, budget=None).collect()
    total = sum(i % 7 + 1 for i in range(300))
    assert sorted(r.doc_id for r in rows) == list(range(300))
    # the slots are the middles of adjoining stretches of tokens
    at = 0
    for r in sorted(rows, key=lambda r: r.slot):
        assert abs(r.slot * total - (at + r.n_tokens / 2)) < 1e-6
        at += r.n_tokens
