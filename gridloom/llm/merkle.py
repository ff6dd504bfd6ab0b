"""Document fingerprints: a Merkle tree over leaves, paragraphs, sections and the root, with DataFrame functions alone.

Paragraphs are the lines of a text. A paragraph is cut into leaves of LEAST to MOST characters that end at
marks of the text itself (sentence marks, commas, blanks after some letters), so an edit moves few borders and
a text of one line has many leaves. A leaf's node is the SHA-256 of its characters, a paragraph's that of its
leaves' nodes, a section's (a run of paragraphs that ends where a paragraph's node says so, every fourth on
average) that of its paragraphs' nodes, the root that of the sections' nodes. Equal texts have equal roots.

Two trees are compared by descent: equal roots are equal texts; sections that both hold count as they are;
the leaves of the others are matched, as often as both hold them. The likeness is twice the matched characters
over the characters of both: a text whose last third is replaced is two thirds like itself.

Defined cases: a null text is empty; an empty text is one empty paragraph without leaves, and its likeness
to a text that differs is 0, as is that of two different texts of line breaks alone; rows whose doc_id is null
are left out; the next document of rows that share a doc_id is that of the next smaller doc_id, there the row
with the smallest hash of its text; a table's only document is its own next; repeated rows have a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

#: A section ends after one paragraph in so many.
SECTION = 4
#: Characters of a leaf; a key keeps a leaf's length in its low bits.
LEAST, MOST, LENGTH_BITS = 24, 512, 10
#: A leaf ends after a mark and the blanks behind it, or after blanks behind one of a few frequent letters, or at MOST.
LEAF = rf"(?s).{{{LEAST},{MOST - 8}}}?(?:[.!?,;:。！？、，；：][ \t]{{0,7}}|(?<=[aenst])[ \t]{{1,7}}|$)|.{{1,{MOST}}}"


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once: a transform over an array of one binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(kind: str, nodes: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(nodes, "")).cast("binary"), 256)


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: node, and the keys of their leaves."""

    def leaf(piece: Column) -> Column:
        key = F.shiftleft(F.xxhash64(piece), LENGTH_BITS).bitwiseOR(F.char_length(piece).cast("long"))
        return F.struct(F.sha2(piece.cast("binary"), 256).alias("node"), key.alias("key"))

    def paragraph(line: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), leaf)
        return _bound(pieces, lambda x: F.struct(_digest("p", x["node"]).alias("node"), x["key"].alias("keys")))

    return F.transform(F.split(text, "\n", -1), paragraph)


def sections(text: Column) -> Column:
    """Array of sections: node, the nodes of their paragraphs, and the keys of the leaves below them."""

    def cut(own: Column) -> Column:
        size = F.size(own)
        ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.pmod(F.xxhash64(F.get(own, i - 1)["node"]), F.lit(SECTION)) == 0))

        def section(first: Column, last: Column) -> Column:
            return _bound(F.slice(own, first, last - first + 1), lambda x: F.struct(_digest("s", x["node"]).alias("node"), x["node"].alias("paragraphs"), F.flatten(x["keys"]).alias("keys")))

        return _bound(ends, lambda e: F.zip_with(F.concat(F.array(F.lit(1)), F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda x: x + 1)), e, section))

    return _bound(paragraphs(text), cut)


def root(tree: Column) -> Column:
    return _digest("r", tree["node"])


def changed(tree: Column, other: Column) -> Column:
    """Nodes of the paragraphs of tree that differ: those missing from other, looked for in differing sections alone."""
    differing = F.filter(tree, lambda s: ~F.array_contains(other["node"], s["node"]))
    return F.array_except(F.flatten(differing["paragraphs"]), F.flatten(other["paragraphs"]))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, root and tree of every document."""
    docs = common.texts(documents).withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", sections(F.col("text")).alias("tree")).select("doc_id", root(F.col("tree")).alias("root"), "tree")


def _followers(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, version, after_id, need): the document that follows after_id, from which it needs so many characters."""
    spark = docs.sparkSession
    ids = docs.groupBy("doc_id").agg(F.min("version").alias("version"), F.count("*").alias("m"), F.floor(F.max(F.char_length("text")) / 3).cast("int").alias("need"))
    ids = ids.repartitionByRange(common.partitions(spark), "doc_id").withColumn("part", F.spark_partition_id())
    ids = common.stored(ids)
    ends = ids.groupBy("part").agg(F.min("doc_id").alias("low"), F.min_by("need", "doc_id").alias("low_need"))
    by_part = Window.orderBy("part")  # a row for each partition
    least = F.first("low").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    need = F.first("low_need").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lead("low").over(by_part), least).alias("beyond"), F.coalesce(F.lead("low_need").over(by_part), need).alias("beyond_need"))
    order = Window.partitionBy("part").orderBy("doc_id")
    ids = ids.select("doc_id", "version", "m", "part", F.lead("doc_id").over(order).alias("up"), F.lead("need").over(order).alias("up_need")).join(ends, "part")
    twice = not ids.where("m > 1").isEmpty()
    return ids.select("doc_id", "version", F.coalesce("up", "beyond").alias("after_id"), F.coalesce("up_need", "beyond_need").alias("need")), twice


def _slim(tree: Column) -> Column:
    """What the descent needs of a tree: a number for each section's node, and the keys of its leaves."""
    return F.transform(tree, lambda s: F.struct(F.xxhash64(s["node"]).alias("section"), s["keys"].alias("keys")))


def _chars(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))


#: Columns of the descent: at leaves, what is left of own and edited and of own and next; in the row of a section,
#: characters of own, edited and next and those matched with edited and next; in a document's row, its copies.
_VALUES = ("v0", "v1", "v2", "v3", "v4", "v5")


def _descended(rows: DataFrame) -> DataFrame:
    """doc_id, head, copies, and the characters of the trees own, edited and next and of what own shares with either.

    rows have doc_id, version, head (a string that comes through) and the slim trees. They are dealt by doc_id, and
    no step here deals them anew. Repeated rows come out once, with their number: all counts are multiples of it.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    trees = ("own", "edited", "next")

    def row(section: Column, keys: Column, tree: str, head: Column) -> Column:
        return F.struct(section.alias("section"), keys.alias("keys"), *(F.lit(int(t == tree)).cast("long").alias(t) for t in trees), head.alias("head"))

    def tagged(tree: str) -> Column:
        return F.transform(tree, lambda s: row(s["section"], s["keys"], tree, none))

    document = F.array(row(F.lit(None).cast("long"), F.array().cast("array<bigint>"), "own", F.col("head")))
    held = rows.select("doc_id", "version", F.inline(F.concat(document, *map(tagged, trees))))
    held = held.groupBy("doc_id", "version", "section").agg(F.first("keys").alias("keys"), F.first("head", ignorenulls=True).alias("head"), *(F.sum(t).alias(t) for t in trees))

    # Sections that both trees hold are matched as they are; what is left of either goes down to its leaves.
    held = held.withColumns({"with_edited": F.least("own", "edited"), "with_next": F.least("own", "next"), "size": F.aggregate("keys", zero, lambda a, k: a + _chars(k))})

    def values(*columns: Column) -> list[Column]:
        return [c.alias(n) for c, n in zip([*columns, *[zero] * (len(_VALUES) - len(columns))], _VALUES, strict=True)]

    of_section = F.struct(F.lit(None).cast("long").alias("leaf"), *values(*(F.col("size") * F.col(n) for n in ("own", "edited", "next", "with_edited", "with_next"))))
    of_document = F.struct(F.lit(None).cast("long").alias("leaf"), *values(*[zero] * 5, F.col("own")))
    left = (F.col("own") - F.col("with_edited"), F.col("edited") - F.col("with_edited"), F.col("own") - F.col("with_next"), F.col("next") - F.col("with_next"))
    differs = (left[0] > 0) | (left[1] > 0) | (left[2] > 0) | (left[3] > 0)
    below = F.transform(F.when(differs, F.col("keys")).otherwise(F.array().cast("array<bigint>")), lambda k: F.struct(k.alias("leaf"), *values(*left)))
    leaves = held.select("doc_id", "version", "head", F.inline(F.concat(F.array(F.when(F.col("section").isNull(), of_document).otherwise(of_section)), below)))
    summed = leaves.groupBy("doc_id", "version", "leaf", "head").agg(*(F.sum(n).alias(n) for n in _VALUES))

    def total(at_leaf: Column, above: str) -> Column:
        return F.sum(F.when(F.col("leaf").isNotNull(), at_leaf).otherwise(F.col(above)))

    matched = total(_chars(F.col("leaf")) * F.least("v0", "v1"), "v3").alias("with_edited"), total(_chars(F.col("leaf")) * F.least("v2", "v3"), "v4").alias("with_next")
    sizes = [total(zero, n).alias(t) for n, t in zip(("v0", "v1", "v2", "v5"), (*trees, "copies"), strict=True)]
    return summed.groupBy("doc_id", "version").agg(F.max("head").alias("head"), *matched, *sizes)


def likeness(same: Column, matched: str, other: str) -> Column:
    both = F.col("own") + F.col(other)
    return F.when(same, 1.0).when(both > 0, 2 * F.col(matched) / both).otherwise(0.0)


def compare(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness: see the query's contract.

    A text's edited text has its last third replaced by as many characters from the start of the next
    document in descending doc_id. Texts are dealt once, by doc_id; only what a neighbour needs travels on.
    """
    docs = common.texts(documents).withColumn("text", F.coalesce("text", F.lit("")))
    followers, twice = _followers(docs.select("doc_id", "text", F.xxhash64("text").alias("version")))
    followers = followers.select(F.col("doc_id").alias("follower"), "version", "after_id", "need")
    # The version is no join key: then both joins deal the texts alike, by doc_id, and Spark deals them once.
    giving = docs.join(followers.hint("merge"), (F.col("doc_id") == F.col("follower")) & (F.xxhash64("text").bitwiseXOR(F.col("version")) == 0))
    if twice:
        giving = giving.dropDuplicates(["doc_id"])
    given = _bound(sections(F.col("text")), lambda t: F.struct(root(t).alias("root"), _slim(t).alias("tree")))
    giving = giving.select("after_id", F.substring("text", F.lit(1), F.col("need")).alias("start"), given.alias("given"))
    giving = giving.select("after_id", "start", F.col("given.root").alias("next_root"), F.col("given.tree").alias("next"))
    rows = docs.join(giving.hint("merge"), F.col("doc_id") == F.col("after_id"))
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - k), F.substring("start", F.lit(1), k)))
    trees = {t: _bound(sections(F.col(c)), lambda t: F.struct(root(t).alias("root"), _slim(t).alias("tree"))) for t, c in (("own", "text"), ("edited", "edited_text"))}
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), n.alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("sha"), "next_root", "next", *(c.alias(t) for t, c in trees.items()))
    head = F.concat_ws(" ", F.col("n_chars").cast("string"), "sha", "own.root", "edited.root", "next_root")
    found = _descended(rows.select("doc_id", "version", head.alias("head"), F.col("own.tree").alias("own"), F.col("edited.tree").alias("edited"), "next"))
    found = found.withColumn("h", F.split("head", " ")).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    h = [F.col("h")[i] for i in range(5)]
    return found.select(
        "doc_id",
        h[0].cast("long").alias("n_chars"),
        h[1].alias("edited_sha256"),
        h[2].alias("fingerprint"),
        h[3].alias("edited_fingerprint"),
        likeness(h[2] == h[3], "with_edited", "edited").alias("near_edited"),
        likeness(h[2] == h[4], "with_next", "next").alias("near_next"),
    )
