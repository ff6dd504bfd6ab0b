from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle


def edited(rows):
    order = sorted(rows, reverse=True)
    out = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        out[doc] = text[: len(text) - k] + after[:k]
    return out


def leaves(text):
    return Counter(x for line in text.split("\n") for x in re.findall(merkle.LEAF, line))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = leaves(a), leaves(b)
    size = sum(len(k) * n for c in (x, y) for k, n in c.items())
    return 2 * sum(len(k) * n for k, n in (x & y).items()) / size if size else 0.0


def following(rows):
    order = sorted(rows, reverse=True)
    return {doc: after or "" for (doc, _), (_, after) in zip(order, order[1:] + order[:1], strict=True)}


def check(df, rows):
    got = {r.doc_id: r for r in merkle.compare(df).collect()}
    want, texts = edited(rows), {d: t or "" for d, t in rows}
    assert set(got) == set(want)
    prints = {d: r.fingerprint for d, r in got.items()}
    for d, r in got.items():
        assert r.n_chars == len(texts[d])
        assert r.edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (texts[d] == want[d])
        assert r.near_edited == pytest.approx(brute_likeness(texts[d], want[d]), abs=1e-12)
        assert r.near_next == pytest.approx(brute_likeness(texts[d], following(rows)[d]), abs=1e-12)
        for e, other in texts.items():
            assert (prints[e] == r.fingerprint) == (other == texts[d])
    return got


def test_small_table(documents):
    got = check(documents, [(r.doc_id, r.text) for r in documents.collect()])
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.8 * len(got)


def test_odd_texts(make):
    rows = [(3, None), (9, ""), (-4, "a\nb\n\nc"), (10**12, "é漢😀 x. y! z? " * 7), (5, "x"), (6, "a\nb\n\nc"), (7, "long " * 50_000)]
    check(make(rows), rows)


def test_leaves_hold_every_character_and_survive_an_insertion():
    for line in ("", "x", "a b c " * 300, "Nomarkswhatsoever" * 100, "漢字、仮名。" * 50, "  blanks   only  in  places ", "é" * 1000 + ". " + "e " * 90):
        assert "".join(re.findall(merkle.LEAF, line)) == line
        assert all(len(x) <= merkle.MOST for x in re.findall(merkle.LEAF, line))
    words = [f"w{i * 7919 % 1000}{'aenstxyz'[i % 8]}" for i in range(2000)]
    line = " ".join(words)
    assert brute_likeness(line, " ".join([*words[:700], "inserted", *words[700:]])) > 0.95


def test_one_line_is_two_thirds_like_its_edited_text(make):
    rows = [(i, " ".join(f"{c}{j * 7919 % 5000}" for j in range(5000))) for i, c in enumerate("abc")]
    got = check(make(rows), rows)
    assert all(0.62 < r.near_edited < 0.69 and r.near_next == 0 for r in got.values())
    same = [(1, "Shti " * 4000), (2, "other words here, " * 900), (3, "line of its own\n" * 500)]
    assert all(0.6 < r.near_edited < 0.7 for r in check(make(same), same).values())


def test_trees_of_more_than_one_level_are_descended(make):
    base = "\n".join(f"Paragraph {i} has one sentence of its own, and ends here {i * 31}." for i in range(60))
    rows = [(2, base), (1, base.replace("Paragraph 30 has", "Paragraph thirty has"))]
    got = check(make(rows), rows)
    assert 0.95 < got[1].near_next < 1 and got[1].near_next == got[2].near_next


def test_one_document_and_none(make):
    check(make([(4, "abc def")]), [(4, "abc def")])
    assert merkle.compare(make([(1, "x")]).where("doc_id > 5")).collect() == []


def test_repeated_rows_have_a_row_each(make):
    got = merkle.compare(make([(2, "one two three"), (2, "one two three"), (1, "four")])).collect()
    assert [r.doc_id for r in sorted(got)] == [1, 2, 2]
    assert len({r.edited_sha256 for r in got}) == 2


def test_changed_paragraphs_are_located(make):
    before = "\n".join(f"paragraph {i}" for i in range(40))
    after = before.replace("paragraph 17", "paragraph seventeen")
    trees = merkle.fingerprints(make([(1, before), (2, after)]))
    a, b = (trees.where(f"doc_id = {d}").select(F.col("tree").alias(f"t{d}")) for d in (1, 2))
    row = a.join(b).select(merkle.changed(F.col("t2"), F.col("t1")).alias("now"), merkle.changed(F.col("t1"), F.col("t2")).alias("was")).first()
    for got, line in ((row.now, b"paragraph seventeen"), (row.was, b"paragraph 17")):
        assert list(got) == [hashlib.sha256(b"p" + hashlib.sha256(line).hexdigest().encode()).hexdigest()]
