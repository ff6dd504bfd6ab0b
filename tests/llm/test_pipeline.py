from __future__ import annotations

import numpy as np
import sentencepiece

import corpus_pipeline
from gridloom.llm import common, mil_quality, mixing, pieces
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {}
        for r in seen.collect():
            before.setdefault(r.doc_id, r)
        after = common.stored(stage(spark, seen, small))
        rows = after.collect()
        if name != "encoding":
            assert after.columns == columns
        if name == "quality":
            model = mil_quality.train(seen, spark.read.parquet(f"{small}/labels.parquet"))
            want = {r.doc_id for r in mil_quality.score(seen, model).collect() if r.score >= 0.3}
            assert {r.doc_id for r in rows} == want and 0 < len(rows) < len(before)
        elif name == "repeated_lines":
            want = {d: n for d, _, n, _ in brute_lines([(d, r.text) for d, r in before.items()])}
            assert len(rows) == len(before)
            assert all(len(before[r.doc_id].text.split("\n")) - want[r.doc_id] == (len(r.text.split("\n")) if want[r.doc_id] < len(before[r.doc_id].text.split("\n")) else 0) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            groups = brute_groups([(d, r.text) for d, r in before.items()], 5, 80)
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _, c, _ in groups if d == c)
        elif name == "source_mixture":
            copies = {r.doc_id: r["count"] for r in mixing.mixture(seen, repetition_limit=2.0).groupBy("doc_id").count().collect()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert got == copies and set(got) == set(before)
        else:
            want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            for r in rows:
                assert r.ids == want.encode(before[r.doc_id].text) and r.n_tokens == len(r.ids)
        seen = after
    assert np.mean([r.n_tokens for r in rows]) > 10


def test_run_gives_the_last_stages_rows(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and got.count() > 0


def test_a_repeated_document_stays_once(spark, make):
    docs = make([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")]).select(*corpus_pipeline.COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_odd_tables_pass_every_stage(spark, make, tmp_path):
    from pyspark.sql import functions as F

    good = "\n".join(f"Sentence number {i} says something of its own, as texts of good quality do." for i in range(6))
    line = "a line that every one of these documents holds, to be kept once"
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "é漢😀 " * 20), (6, "word " * 200_000), (7, "one two three four five six"), (None, "lost"), (8, good), (9, good + " Really.")]
    rows += [(20 + i, f"{line}\nOwn words of document {i}, which nobody else has said before {i * 37}.") for i in range(6)]
    docs = make(rows).withColumn("_keep", F.lit(1)).withColumn("_doc", F.lit("x")).withColumn("score", F.lit(9)).withColumn("ids", F.lit(2))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("doc_id < -5"), str(tmp_path))
        assert empty.collect() == []
        docs = common.stored(stage(spark, docs, str(tmp_path)))
        seen[name] = {}
        for r in docs.collect():
            seen[name].setdefault(r.doc_id, []).append(r)
    ids = {1, 2, 3, 4, 5, 6, 7, 8, 9, *range(20, 26)}
    assert set(seen["quality"]) == ids and len(seen["quality"][4]) == 2
    assert seen["repeated_lines"][1][0].text == "" and seen["repeated_lines"][1][0].n_chars == 0
    assert [d for d, r in seen["repeated_lines"].items() if line in r[0].text] == [25]
    assert set(seen["near_duplicates"]) == ids - {7, 9} and len(seen["near_duplicates"][4]) == 1
    assert set(seen["source_mixture"]) == ids - {7, 9}
    final = seen["encoding"]
    assert set(final) == ids - {7, 9} and final[1][0].n_tokens == final[2][0].n_tokens == 0 and final[6][0].n_tokens >= 200_000
