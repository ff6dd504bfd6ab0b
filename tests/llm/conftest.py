from __future__ import annotations

import pytest


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture
def make(spark):
    """Documents from texts or (doc_id, text) pairs, with further columns whose names could clash."""

    def build(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, "x", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, token string, n int")

    return build
