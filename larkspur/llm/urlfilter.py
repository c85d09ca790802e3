"""URL filters by a sort-merge range join.

A host is written in reverse (``com.example.``), so a host and its subdomains are one interval of
the sorted keys. URLs are dealt into ranges of keys; each rule goes to the ranges that its interval
meets, which for most is one. In a range, a sweep over the sorted URLs and rule hosts keeps a stack of the
rule hosts whose intervals are open, each nested in the one below; it begins with those that are
open at the range's first key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import Scratch

#: URLs of a range, about; small tables have some ranges for each core.
ROWS_PER_RANGE = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """The host up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``; a domain's key is a prefix of its subdomains' keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Sweep:
    """The rules that fit URLs whose keys come in ascending order."""

    def __init__(self, rules: Sequence[Rule]):
        by_host: dict[str, dict[str, Rule]] = {}
        for r in rules:
            by_host.setdefault(_key(r.host), {}).setdefault(r.path, r)
        self.hosts = sorted(by_host)
        self.paths = [(by_host[h], sorted({len(p) for p in by_host[h]}, reverse=True)) for h in self.hosts]
        self.next = 0
        self.open: list[int] = []
        self.key: str | None = None

    def move(self, key: str) -> None:
        """Close the intervals that end before ``key`` and open those that hold it."""
        if key == self.key:
            return
        self.key = key
        while self.open and not key.startswith(self.hosts[self.open[-1]]):
            self.open.pop()
        while self.next < len(self.hosts) and self.hosts[self.next] <= key:
            if key.startswith(self.hosts[self.next]):
                self.open.append(self.next)
            self.next += 1

    def rule(self, path: str) -> Rule | None:
        """The longest fitting rule, by host and path together; of equally long ones that of the longer host."""
        best = None
        for i in reversed(self.open):
            paths, lengths = self.paths[i]
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    if best is None or len(paths[path[:n]].text) > len(best.text):
                        best = paths[path[:n]]
                    break
        return best


def rule_table(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """host, path, verdict and turn of rules; a table of rules may say their ``turn`` itself."""
    if isinstance(rules, DataFrame):
        turn = F.col("turn").cast("long") if "turn" in rules.columns else F.lit(0).cast("long")
        return rules.where("host is not null and path is not null").select("host", "path", "verdict", turn.alias("turn"))
    rows = [(r.host, r.path, r.verdict, i) for i, r in enumerate(rules)]
    return urls.sparkSession.createDataFrame(rows, "host string, path string, verdict string, turn long")


def dealt(rules: DataFrame, bounds: list[tuple[int, str, str]]) -> DataFrame:
    """The rules, with their key, in each range (number, least key, largest key) that their interval meets."""
    numbers, least, largest = ([b[i] for b in bounds] for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            keys = [_key(h) for h in hosts]
            # the interval of a key ends before the key with its last character raised; the empty key's has no end
            spans = [range(bisect_left(largest, k), bisect_left(least, k[:-1] + chr(ord(k[-1]) + 1)) if k else len(least)) for k in keys]
            at = [i for i, span in enumerate(spans) for _ in span]
            to = [numbers[j] for span in spans for j in span]
            if at:
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([keys[i] for i in at]), *part.columns], ["range",
                        "key", "host", "path", "verdict", "turn"])

    return rules.mapInArrow(run, "range int, key string, host string, path string, verdict string, turn long")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url, one row each.

    Of the rules that fit a url the longest counts, of equally long ones that of the longer host; of rules
    with equal host and path that with the least ``turn`` (a sequence's order), then the least verdict. Without
    a fitting rule, rule is null and the verdict ``default``. A rule with an empty host fits all urls; null
    and malformed ones, whose host and path are empty, are fit by no other. A hot host is cut by path and id into several ranges.
    Rules are never collected or broadcast; a task holds those of its range.
    """
    spark = pages.sparkSession
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    scratch, n = Scratch(spark, "urls"), pages.count()
    ranges = max(-(-n // ROWS_PER_RANGE), min(4 * spark.sparkContext.defaultParallelism, -(-n // 1000)), 1)
    urls = scratch.keep(rows.repartitionByRange(ranges, "key", "path", "page_id").withColumn("range", F.spark_partition_id()), "keys")
    found = urls.groupBy("range").agg(F.min("key").alias("least"), F.max("key").alias("largest")).collect()  # a row a range
    bounds = sorted((tuple(r) for r in found), key=lambda b: (b[1], b[2]))
    kind = urls.schema["page_id"].dataType
    own = dealt(rule_table(pages, rules), bounds).select("range", F.lit(False).alias("url"), F.lit(None).cast(kind).alias("page_id"),
        "host", "path", "key", "verdict", "turn")
    both = own.unionByName(urls.select("range", F.lit(True).alias("url"), "page_id", "host", "path", "key", F.lit(None).cast("string")
            .alias("verdict"), F.lit(None).cast("long").alias("turn")))
    schema = StructType([StructField("page_id", kind), *[StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sweep = None, [], None
        for batch in batches:
            names, verdicts, keep = [], [], []
            was, rule = None, None
            for i, (number, url, h, p, key, verdict) in enumerate(zip(*[batch.column(j).to_pylist() for j in (0, 1, 3, 4, 5, 6)])):
                if number != now:
                    now, held, sweep, was = number, [], None, None
                if not url:
                    held.append(Rule(h, p, verdict))
                    continue
                if sweep is None:
                    sweep = Sweep(held)
                if (key, p) != was:
                    was = (key, p)
                    sweep.move(key)
                    rule = sweep.rule(p)
                keep.append(i)
                names.append(rule and rule.text)
                verdicts.append(rule.verdict if rule else default)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(names, pa.string()),
                    pa.array(verdicts, pa.string())], schema.names)

    return both.repartition("range").sortWithinPartitions("range", "url", "key", "path", "turn", "verdict").mapInArrow(run, schema)
