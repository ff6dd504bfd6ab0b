"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's weight is its share of all tokens raised to an exponent in [0, 1] and normalised; 1 keeps the
corpus as it is, 0 gives every source the same. The exponent is bisected to the largest one that meets a
target entropy, or to the smallest one that shows no source more than repetition_limit times. The weights
times a token budget say how often each source is seen: whole epochs, then part of one. An epoch is a
permutation of the source's blocks (documents dealt by hash) and of the documents in each block, so no
source is ever ordered in one task; the part of an epoch takes the documents that fit its token budget.
Rows sorted by slot have the target weights in every stretch.

Defined cases: a null or empty text has no tokens; a null source is a source of its own; sources without
tokens have weight 0 and each of their documents comes once; rows whose doc_id is null are left out; equal
rows (doc_id, text and source) are one document here; without tokens at all every document comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block, and blocks in a group, about.
BLOCK, GROUP = 2048, 4096
#: Sources that one row of totals may hold; more raise an error.
MOST_SOURCES = 1_000_000
STEPS = 52


def counted(documents: DataFrame) -> DataFrame:
    """(doc_id, version, source, mix, tokens) of every distinct document; mix names the source, null included."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source")).where("doc_id is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("mix"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens"))
    return common.stored(docs.dropDuplicates(["doc_id", "version", "mix"]))


def _weights(totals: Column, exponent: Column) -> Column:
    powers = F.transform(totals, lambda t: F.when(t > 0, F.pow(t / F.array_max(totals), exponent)).otherwise(0.0))
    whole = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: F.when(whole > 0, p / whole).otherwise(0.0))


def weights(totals: DataFrame, repetition_limit: float = 2.0, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(mix, total, documents, weight, repeats) from (mix, total, documents); entropy, in nats, replaces the limit.

    Without a budget it is the smallest that shows every document at least once.
    """
    few = totals.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("mix", "total", "documents"))).alias("all"))
    few = few.select(F.when(F.col("n") <= MOST_SOURCES, F.col("all")).otherwise(F.raise_error(F.lit("too many sources"))).alias("all"))
    few = few.withColumn("t", F.transform("all", lambda x: x["total"].cast("double")))

    def repeats(exponent: Column) -> Column:
        w = _weights(F.col("t"), exponent)
        each = F.zip_with(F.col("t"), w, lambda t, x: F.when(x > 0, t / x).otherwise(0.0))
        whole = F.lit(float(budget)) if budget is not None else F.array_max(each)
        return F.transform(each, lambda e: F.when(e > 0, whole / e).otherwise(1.0))

    def fits(exponent: Column) -> Column:
        if entropy is None:
            return F.array_max(repeats(exponent)) <= repetition_limit
        nats = F.aggregate(_weights(F.col("t"), exponent), F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
        return nats >= entropy

    def half(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        go = fits(middle)
        down = go if entropy is None else ~go  # the limit is met by larger exponents, the entropy by smaller ones
        return F.struct(F.when(down, state["low"]).otherwise(middle).alias("low"), F.when(down, middle).otherwise(state["high"]).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, half)
    edge, ends = (0.0, "high") if entropy is None else (1.0, "low")
    few = few.withColumn("exponent", F.when(fits(F.lit(edge)), F.lit(edge)).otherwise(found[ends]))
    few = few.withColumn("w", _weights(F.col("t"), F.col("exponent"))).withColumn("r", repeats(F.col("exponent")))
    rows = few.select("exponent", F.explode(F.arrays_zip("all", "w", "r")).alias("x"))
    return rows.select("x.all.mix", "x.all.total", "x.all.documents", F.col("x.w").alias("weight"), F.col("x.r").alias("repeats"), "exponent")


def mixture(documents: DataFrame, repetition_limit: float = 2.0, entropy: float | None = None, budget: float | None = None, seed: int = 1) -> DataFrame:
    """A row for each time a document is shown: doc_id, version, source, n_tokens, weight, epoch, slot."""
    docs = counted(documents)
    totals = docs.groupBy("mix").agg(F.sum("tokens").alias("total"), F.count("*").alias("documents"))
    plan = common.stored(weights(totals, repetition_limit, entropy, budget))
    # A row for each source, MOST_SOURCES at most; Spark picks a broadcast by its size.
    rows = docs.join(plan, "mix").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor("repeats").cast("int"))))
    rows = rows.where(F.col("epoch") < F.col("repeats"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "version"), blocks)).withColumn("place", F.xxhash64(F.lit(seed), "epoch", "doc_id", "version"))

    rows = common.stored(rows.select("mix", "doc_id", "version", "source", "tokens", "total", "weight", "repeats", "epoch", "block", F.pmod("block", F.ceil(blocks / GROUP)).alias("group"), "place"))
    # Blocks come in groups, so that no window orders more than GROUP blocks, or one row for each group of a source.
    sizes = rows.groupBy("mix", "epoch", "group", "block").agg(F.sum("tokens").alias("size")).withColumn("turn", F.xxhash64(F.lit(seed), "epoch", "block"))
    groups = sizes.groupBy("mix", "epoch", "group").agg(F.sum("size").alias("size")).withColumn("turn", F.xxhash64(F.lit(seed), "epoch", "group"))

    def starts_of(rows: DataFrame, within: tuple[str, ...], key: str) -> DataFrame:
        running = Window.partitionBy(*within).orderBy("turn", key).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("start", F.coalesce(F.sum("size").over(running), F.lit(0))).select(*within, key, "start")

    starts = starts_of(sizes, ("mix", "epoch", "group"), "block")
    starts = starts.join(starts_of(groups, ("mix", "epoch"), "group").withColumnRenamed("start", "group_start"), ["mix", "epoch", "group"])
    starts = starts.select("mix", "epoch", "block", (F.col("start") + F.col("group_start")).alias("start"))
    inside = Window.partitionBy("mix", "epoch", "block").orderBy("place", "doc_id", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum("tokens").over(inside)).join(starts, ["mix", "epoch", "block"])
    done = F.col("start") + F.col("within")
    rows = rows.where((F.col("epoch") + 1 <= F.col("repeats")) | (done <= (F.col("repeats") - F.col("epoch")) * F.col("total")))
    slot = (F.col("epoch") + F.when(F.col("total") > 0, (done - F.col("tokens") / 2) / F.col("total")).otherwise(0.5)) / F.col("repeats")
    return rows.select("doc_id", "version", "source", F.col("tokens").alias("n_tokens"), "weight", "epoch", slot.alias("slot"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """documents with every row as often as the mixture shows it; rows are not ordered.

    Equal rows are repeated alike. A document that the budget leaves out has no row. Further columns may have any name.
    """
    names = documents.columns
    doc, version, of, copies_of = (common.unused(n, names) for n in ("_doc", "_version", "_mix", "_copies"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    copies = mixture(documents, **options).groupBy("doc_id", "version", source.alias("mix")).agg(F.count("*").cast("int").alias("n"))
    copies = copies.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("mix").alias(of), F.col("n").alias(copies_of))
    same = (F.col("doc_id") == F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(version)) & (source == F.col(of))
    rows = documents.join(copies, same).withColumn(copies_of, F.explode(F.sequence(F.lit(1), F.col(copies_of))))
    return rows.select(*(F.col(f"`{n}`") for n in names))
