"""URL filters: a sort-merge range join of canonical keys with the intervals of prefix rules.

A rule (host, path) fits its host and all subdomains where the path starts with its own. A url gives one
key for each suffix of its host that a rule could name: the suffix's labels reversed, a separator, the
path. A rule is the interval of keys that start with its key. Keys and rules are dealt by range of
(key, page) and sorted; a sweep keeps the stack of the rules that are open at a key, of which the top is
the longest, and partitions hand the rules still open to those after them. A page's rule is the longest
over its keys. Equal urls spread over partitions by page, so no host or url is a hot key.

Defined cases: a null url or one without :// has an empty host and path and fits no rule; a path that is
empty fits only rules with an empty path; of rules with the same host and path a block wins; of fitting
rules of equal length the longer host wins; rows whose page_id is null are kept; repeated rows give a row
each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Ends the host in a key; no host holds it, so no rule fits across it.
SEPARATOR = "?"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(SEPARATOR), path)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


class Sweep:
    """The stack of open rules, outermost first; keys must come in order."""

    def __init__(self, stack: list[tuple[str, int, str, str]]):
        self.stack = stack

    def reach(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, length: int, rule: str, verdict: str) -> None:
        self.reach(key)
        if self.stack and self.stack[-1][0] == key:
            self.stack.pop()
        self.stack.append((key, length, rule, verdict))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each partition: its first and last key and the rules of its own still open at its last key."""
    first, last, sweep = None, "", Sweep([])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        first = keys[0].as_py() if first is None else first
        last = keys[-1].as_py()
        rules = batch.filter(batch.column("rule").is_valid())
        for row in rules.select(["key", "length", "rule", "verdict"]).to_pylist():
            sweep.open(*row.values())
    if first is not None:
        sweep.reach(last)
        stack = [dict(zip(("key", "length", "rule", "verdict"), s, strict=True)) for s in sweep.stack]
        kind = pa.list_(pa.struct([("key", pa.string()), ("length", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first]), pa.array([last]), pa.array([stack], kind)], ["part", "first", "last", "stack"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, or null) and verdict of every page."""
    spark = pages.sparkSession
    common.prepare(spark)
    host, path = parts(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    name = F.concat("host", "path")
    opened = rules.select(_key(F.col("host"), F.col("path")).alias("key"), (F.char_length(name) * 1024 + F.least(F.lit(1023), F.char_length("host"))).cast("int").alias("length"), name.alias("rule"), F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0]
    if not deepest:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.slice(F.reverse(labels), F.lit(1), k))
    keyed = pages.where("host <> ''").withColumn("suffix", F.explode(suffixes))
    keyed = keyed.select(F.concat(F.array_join("suffix", "."), F.lit(SEPARATOR), "path").alias("key"), F.lit(1).alias("after"), F.col("page_id"), "host", "path", *(F.lit(None).cast(t).alias(n) for n, t in (("length", "int"), ("rule", "string"), ("verdict", "string"))))
    events = keyed.union(opened.select("key", F.lit(0), *(F.lit(None).cast(t) for t in ("long", "string", "string")), "length", "rule", "verdict"))
    order = ("key", "after", "page_id")
    dealt = common.fixed(common.stored(events).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order))
    ends = sorted(dealt.mapInArrow(_ends, "part long, first string, last string, stack array<struct<key:string,length:int,rule:string,verdict:string>>").collect(), key=lambda r: r["part"])
    carried, sweep = {}, Sweep([])
    for r in ends:  # a row for each partition, as many rules as nest at its last key
        sweep.reach(r["first"])
        carried[r["part"]] = list(sweep.stack)
        sweep.reach(r["last"])
        for s in r["stack"]:
            sweep.open(*s)

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(list(carried.get(TaskContext.get().partitionId(), [])))
        for batch in batches:
            rows, found = [], []
            keys, after = batch.column("key").to_pylist(), batch.column("after").to_pylist()
            for i, key in enumerate(keys):
                if after[i]:
                    sweep.reach(key)
                    if sweep.stack:
                        rows.append(i)
                        found.append(sweep.stack[-1])
                else:
                    sweep.open(key, *(batch.column(n)[i].as_py() for n in ("length", "rule", "verdict")))
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(n) for n in ("page_id", "host", "path")), *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string())))], ["page_id", "host", "path", "length", "rule", "verdict"])

    fits = dealt.mapInArrow(sweeps, "page_id long, host string, path string, length int, rule string, verdict string")
    best = fits.groupBy("page_id", "host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    best = best.select(F.col("page_id").alias("_page"), F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
    return pages.join(best, same, "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


_names = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
ORACLE = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*', 0, 's') AS h, r FROM rest
), parsed AS (
  SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*', 0, 's') AS path FROM split
), ruled AS (
  SELECT *, CASE {_names} END AS rule FROM parsed
)
SELECT page_id, host, path, rule, CASE rule {_verdicts} ELSE 'allow' END AS verdict FROM ruled
"""
