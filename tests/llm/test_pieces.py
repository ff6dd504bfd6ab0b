from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from gridloom.llm import pieces

ODD = ["", " ", "  a  b ", "\n\n x\ty", "漢字 é ﬁ 😀😀 a", "</s> <s> <0x0A> <unk>", "x" * 3000, "aaaaaaaaa bbbbbb " * 3, "The quick brown fox jumps, over 12345 lazy dogs!!! http://x.y/z?q=1&b=2"]


def test_ids_are_the_librarys(documents):
    rnd = random.Random(1)
    texts = [r.text or "" for r in documents.collect()] + ODD
    texts += ["".join(rnd.choice("abcdethe ing onTHE \n.,!éñü123") for _ in range(200)) for _ in range(100)]
    encoder = pieces.Encoder(pieces.Vocabulary())
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)
    assert [np.frombuffer(c, np.int32).tolist() for c in encoder.encode(texts)] == want
    assert [np.frombuffer(c, np.int32).tolist() for c in encoder.encode(texts[::-1])] == want[::-1]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 10)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 10)
    encoder = pieces.Encoder(pieces.Vocabulary())
    for i in range(20):
        encoder.encode([f"word{i} other{i} thing{i}"])
    assert len(encoder.words) <= 13 and len(encoder.pairs) <= 10


def test_round_trip_of_a_table(make):
    rows = [*enumerate(ODD), (50, None), (51, "again"), (51, "again"), (52, "a▁b"), (None, "lost")]
    got = sorted((r.doc_id, r.n_tokens, r.round_trip) for r in pieces.digest(make(rows)).collect())
    assert [g[0] for g in got] == sorted(d for d, _ in rows if d is not None)
    assert all(g[2] for g in got if g[0] != 52) and not [g for g in got if g[0] == 52][0][2]
    assert {g[1] for g in got if g[0] in (0, 50)} == {0}
    assert pieces.digest(make(rows).where("doc_id > 60")).collect() == []


def unigram_model(path, fallback):
    """A model of pieces put down by hand; scores in eighths, so that sums are exact and equal sums occur."""
    rnd = random.Random(3)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, fallback
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix = "identity", True
    spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces = False, True
    known = sorted({pieces.MARK * rnd.randrange(2) + "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(400)} | set("abcde") | {pieces.MARK})
    for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + ([(f"<0x{i:02X}>", 6) for i in range(256)] if fallback else []) + [(k, 1) for k in known]:
        spec.pieces.add(piece=piece, type=kind, score=-rnd.randrange(8, 80) / 8 if kind == 1 else 0.0)
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [True, False])
def test_viterbi_of_a_unigram_model_is_the_librarys(tmp_path, make, fallback):
    path = unigram_model(tmp_path / "m.model", fallback)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcde abcde éxy漢") for _ in range(rnd.randrange(0, 120))) for _ in range(400)] + ["xyz", "a  b", "", "漢漢a"]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = library.encode(texts)
    encoder = pieces.Encoder(pieces.Vocabulary(path))
    assert [np.frombuffer(c, np.int32).tolist() for c in encoder.encode(texts)] == want
    got = {r.doc_id: r for r in pieces.digest(make(texts[:60]), path).collect()}
    assert all(list(got[i].ids) == want[i] and (got[i].round_trip or not fallback) for i in range(60))


def test_the_query_gives_ids_and_texts_of_every_document(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    got = pieces.digest(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library.encode(rows[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded == rows[r.doc_id]


def test_columns_called_like_results_are_left_out(make):
    docs = make([(1, "some words")]).withColumn("ids", F.lit(3)).withColumn("decoded", F.lit("x")).withColumn("a.b", F.lit(1))
    got = pieces.decode(pieces.encode(docs, extra=("lang", "ids", "decoded")))
    assert got.columns == ["doc_id", "text", "lang", "ids", "decoded"] and got.first().decoded == "some words"
