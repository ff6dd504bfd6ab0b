"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Distinct marked words are sorted, which walks their trie depth-first, and the forward states of a common prefix
are computed once. In a unigram model the state of a prefix is Viterbi's: the best score of its segmentations and
the piece that ends it. A BPE model's segmentation is not the best-scored path, so there the state is the last
piece of the prefix's BPE. That state follows from the states of shorter prefixes alone: it is the one piece that
ends there and forms a stable pair with the last piece before it (BPE over both gives just those two).

Defined cases: a null or empty text has no ids; characters outside the vocabulary become byte pieces, or without
such pieces the unknown one, once for a run of them; a text that holds U+2581 itself decodes with spaces there,
as the model's marking demands; rows whose doc_id is null are left out; repeated rows are encoded each; further
columns of any name come through, but those called like a column of the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from gridloom.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words and piece pairs that a worker remembers before it starts anew.
WORDS_KEPT, PAIRS_KEPT = 1_000_000, 400_000

#: Fixed value: how far an unknown character scores below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0

_word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, ids and scores of a model, as plain tables that can be sent to executors."""

    def __init__(self, path: str = MODEL):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        self.unigram = trainer.model_type == 1
        if not (self.unigram or trainer.model_type == 2 and trainer.byte_fallback) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only unigram models and BPE models with byte fallback, without normalisation, are supported")
        model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.fallback, self.unknown = trainer.byte_fallback, model.unk_id()
        self.prefix = norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("pieces that span words are not supported")
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.codes = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.reach: dict[str, int] = {}  # longest piece that ends in two characters
        for p in self.ids:
            if len(p) > 1:
                self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: merge the best pair, the leftmost of equals, until none is left."""
        parts, scores = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, before: str, piece: str) -> bool:
        """Whether BPE over both gives just these two (before may be empty)."""
        got = self.pairs.get((before, piece))
        if got is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            got = self.merged(before + piece) == ([before, piece] if before else [piece])
            self.pairs[before, piece] = got
        return got

    def learn(self, words: list[str]) -> None:
        """Encode sorted distinct words, reusing the states of the prefix that each shares with the one before."""
        (self._learn_best if self.v.unigram else self._learn_merges)(words)

    def _learn_best(self, words: list[str]) -> None:
        """Viterbi: best[i] and last[i] are the score and the last piece of the best segmentation of i characters."""
        scores, longest, worst = self.v.scores, self.v.longest, self.v.worst
        best, last, shown = [0.0], [""], ""
        for word in words:
            k = 0
            for a, b in zip(shown, word, strict=False):
                if a != b:
                    break
                k += 1
            del best[k + 1 :], last[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                top = piece = None
                for start in range(max(0, i - longest), i):  # of equal scores the longest piece
                    own = scores.get(word[start:i])
                    if own is not None and (top is None or best[start] + own > top):
                        top, piece = best[start] + own, word[start:i]
                if word[i - 1] not in scores and (top is None or best[i - 1] + worst > top):
                    top, piece = best[i - 1] + worst, word[i - 1]
                best.append(top)
                last.append(piece)
            self.words[word] = self._walked(word, last)
            shown = word

    def _learn_merges(self, words: list[str]) -> None:
        ids, pairs, reach = self.v.ids, self.pairs, self.v.reach
        last: list[str] = [""]  # last[i]: last piece of the first i characters
        shown = ""
        for word in words:
            k = 0
            for a, b in zip(shown, word, strict=False):
                if a != b:
                    break
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                for start in range(max(0, i - reach.get(word[i - 2 : i], 1)) if i > 1 else 0, i):
                    piece = word[start:i]
                    if piece in ids:
                        before = last[start]
                        good = pairs.get((before, piece))
                        if good or good is None and self.stable(before, piece):
                            last.append(piece)
                            break
                else:
                    last.append(word[i - 1])
            self.words[word] = self._walked(word, last)
            shown = word

    def _walked(self, word: str, last: list[str]) -> bytes:
        """Ids of a word by walking back over its states."""
        out, i, codes, unknown = [], len(word), self.v.codes, None
        while i:
            piece = last[i]
            code = codes.get(piece)
            if code is None:
                if self.v.fallback:
                    code = b"".join(self.v.byte_ids[x].to_bytes(4, "little") for x in piece.encode())
                else:
                    code = b"" if unknown == i else self.v.unknown.to_bytes(4, "little")
                    unknown = i - len(piece)
            out.append(code)
            i -= len(piece)
        out.reverse()
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        mark = MARK if self.v.prefix else ""
        split = [_word.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        self.learn(sorted({w for words in split for w in words} - self.words.keys()))
        code = self.words.__getitem__
        return [b"".join(map(code, words)) for words in split]


_encoders: dict[str, Encoder] = {}


def encoder_for(name: str, vocabulary: Broadcast) -> Encoder:
    """The worker's encoder for a vocabulary, kept from task to task with the words it knows."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary.value)
    return _encoders[name]


def _lists(codes: list[bytes]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(codes), np.int32)))


def encode(documents: DataFrame, model: str = MODEL, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of extra, and ids: the array of piece ids."""
    spark = documents.sparkSession
    common.prepare(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model))  # as large as the vocabulary file
    rows = documents.where("doc_id is not null").select("doc_id", "text", *(n for n in extra if n.lower() not in ("doc_id", "text", "ids")))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(name, vocabulary)
        for batch in batches:
            ids = _lists(encoder.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def texts_of(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    """The text that each list of ids stands for; a null list is an empty text."""
    values = ids.values.to_numpy(zero_copy_only=False).tolist() if len(ids.values) else []
    bounds = ids.offsets.to_numpy().tolist()
    piece = v.bytes_of.__getitem__
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        text = b"".join(map(piece, values[a:b])).decode("utf-8", "replace")
        out.append(text[1:] if v.prefix and text.startswith(" ") else text)
    return pa.array(out, pa.string())


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with the column decoded: the text that its ids stand for."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))
    encoded = encoded.select(*(F.col(f"`{n}`") for n in encoded.columns if n.lower() != "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(batch.column("ids"), vocabulary.value)], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def digest(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and round_trip (whether decoding gives the text again) of every document.

    Encoding and decoding in one pass, so that texts and ids go to the workers and back once.
    """
    spark = documents.sparkSession
    common.prepare(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(name, vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = _lists(encoder.encode(texts))
            decoded = texts_of(ids, encoder.v)
            same = [(t or "") == d for t, d in zip(texts, decoded.to_pylist(), strict=True)]
            sizes = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, ids, decoded, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded", "round_trip"])

    return common.texts(documents).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string, round_trip boolean")
