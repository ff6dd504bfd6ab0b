from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from gridloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_documents=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < min_documents or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in line_dedup.digest(df).collect())


def test_small_table_against_brute_force_and_sql(spark, small, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = found(documents)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.ORACLE})").fetchall()) == got


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_hot_lines_over_partitions(spark, make, parts):
    rnd = random.Random(2)
    lines = [f"  Line {i} " + "abcdé " * 7 for i in range(30)] + ["short"] * 5
    rows = [(i * 7, "\n".join(["A line that every document holds, more or LESS." + " " * (i % 3)] + rnd.choices(lines, k=rnd.randrange(6)) + [f"own line {i} " * 5] * 2)) for i in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(make(rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(make):
    line = "x" * 39 + "É"
    rows = [(i, f"{line}\n{line}\r\n\t{line} ") for i in range(6)] + [(10, None), (11, ""), (12, "\n\n"), (13, "y" * 2_000_000), (-3, line)]
    assert found(make(rows)) == brute(rows)
    assert found(make([(None, line)] + rows)) == brute(rows)
    assert found(make(rows).where("doc_id > 100")) == []


def test_repeated_rows_count_as_one_document(make):
    line = "z" * 50
    rows = [(1, line)] * 3 + [(2, line), (3, line), (4, line), (4, "other\n" + line)]
    assert [r[2] for r in found(make(rows))] == [0] * 7
    assert [r[2] for r in found(make([*rows, (5, line)]))] == [1] * 7 + [0]


def test_bitmaps_name_the_lines_that_stay(make):
    line = "w" * 45
    rows = [(i, "\n".join([line, "a", line, *"bcdefghijk", line, "tail"])) for i in range(5)]
    got = {r.doc_id: np.unpackbits(np.frombuffer(zlib.decompress(bytes(r.keep)), np.uint8)).tolist() for r in line_dedup.keep_bitmaps(make(rows)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0] == [0, 1, 0] + [1] * 10 + [0] + [1] * 2


def test_the_sweep_is_the_same_however_rows_are_cut():
    import numpy as np

    rnd = np.random.default_rng(5)
    for least in (2, 3, 5):
        keys = rnd.integers(0, 6, 400) ** 2 % 7
        back = -rnd.integers(0, 9, 400)
        rows = sorted(zip(keys.tolist(), (keys % 2).tolist(), back.tolist(), range(400), strict=True))
        documents, keeper = {}, {}
        for h, w, b, _ in rows:
            documents.setdefault((h, w), set()).add(b)
            keeper.setdefault((h, w), b)
        want = {r[3] for r in rows if len(documents[r[:2]]) >= least and r[2] != keeper[r[:2]]}
        columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
        borders = {0, 400}  # partitions never part the lines of one document for a key
        borders |= {int(i) for i in rnd.choice(399, 5) + 1 if rows[int(i)][:3] != rows[int(i) - 1][:3]}
        got = []
        for a, z in zip(sorted(borders)[:-1], sorted(borders)[1:], strict=True):
            first, last = rows[a][:2], rows[z - 1][:2]
            before = len({r[2] for r in rows[:a] if r[:2] == first})
            after = len({r[2] for r in rows[z:] if r[:2] == last})
            sweep, at = line_dedup.Sweep(least, (first, before), (last, after)), a
            while at < z:
                n = min(z - at, int(rnd.integers(1, 40)))
                for part in sweep.stretch([c[at : at + n] for c in columns]):
                    got += part[3].tolist()
                at += n
            for part in sweep.end():
                got += part[3].tolist()
        assert sorted(got) == sorted(want)


def test_columns_of_any_name_come_through(make):
    docs = make([(i, "a line that many documents hold, over forty\nown " + str(i)) for i in range(6)])
    for name in ("_keep", "_doc", "_version", "keep", "version"):
        docs = docs.withColumn(name, F.lit(3))
    got = line_dedup.apply_bitmaps(docs.withColumn("n_lines", F.lit(9)), line_dedup.keep_bitmaps(docs), ("_keep", "_doc", "_version", "keep", "version", "n_lines"))
    assert [(r._keep, r._doc, r.version, r.n_lines) for r in got.collect()] == [(3, 3, 3, 2)] * 6 and got.agg(F.sum("n_dropped")).first()[0] == 5
