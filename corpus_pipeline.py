"""From raw documents to token ids: quality, repeated lines, near-duplicates, source mixture, encoding.

Each stage takes the documents that the one before kept and returns the columns of documents; the last
returns doc_id, lang, source, n_tokens and ids. Line dedup empties documents whose every line stays
elsewhere; their rows are kept and have no tokens.

Cases that hold for all stages: further columns, whatever their names, are left out; rows whose doc_id is null
go in the first stage; a null text counts as empty and is empty after the second stage; texts of any length are
taken whole; an empty table gives an empty one. What repeated rows, ties and odd texts lead to is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, line_dedup, mil_quality, mixing, ngram_join, pieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go; a score of just 0.3 stays.

    A null or empty text is one empty passage with a score like any other. Repeated rows are scored each. Without
    labels of both kinds every score is the share of good labels, so that all documents stay or none.
    """
    docs = docs.select(*COLUMNS).where("doc_id is not null")
    model = mil_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mil_quality.score(docs, model, keep=schema).where("score >= 0.3").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents or more hold stay in the last of them alone.

    A null text becomes empty. Every row stays, if need be with an empty text. The rows of one doc_id are one
    document in the count, and each loses its own lines; a line repeated within its last document stays there.
    """
    cut = line_dedup.apply_bitmaps(docs.select(*COLUMNS), line_dedup.keep_bitmaps(docs), ("lang", "source"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles with a Jaccard of 0.8 or more, the smallest doc_id stays.

    Texts without words are linked with nothing and all stay. Of rows with equal doc_id and text one stays; rows
    of one doc_id with other texts stay each, unless a smaller doc_id is linked to one of them.
    """
    found = common.stored(ngram_join.classes(docs, width=5, percent=80))
    docs = docs.select(*COLUMNS)
    stay = docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return stay.select(*COLUMNS)
    again = stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(twice, "doc_id", "left_anti").select(*COLUMNS).union(again.select(*COLUMNS))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that no source is shown more than twice as often as the largest.

    A null source is a source of its own. Documents without words come once. Equal rows are repeated alike.
    """
    return mixing.mixed(docs.select(*COLUMNS), repetition_limit=2.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, of repeated ones each; a null or empty text has none."""
    ids = pieces.encode(docs, extra=("lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("encoding", encoding),
]

#: A trained classifier and word pieces are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
