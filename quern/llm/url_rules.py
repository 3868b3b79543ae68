"""URL filters: a sort-merge range join of urls with nested host and path rules.

A host's labels in reverse, each ended by a dot (com.example.www.), make a host and all its subdomains one interval of
sorted keys. Urls and rules are cut into ranges of (key, path, row), so that a host of many urls is cut too, and a rule goes
to each of the neighbouring ranges that its interval meets. Each range is sorted, and one sweep over it keeps a stack of
the hosts whose interval is open; those that the next key leaves are popped. The path prefixes of a host nest in the same
way: when they are opened, each is linked to the next one around it, so that the longest that fits a path is found by a
bisection and a walk outwards.

Where the ranges are cut follows from a sample of about CUT_SAMPLE urls, which decides on the sizes of tasks alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import partitions

RANGE_URLS, CUT_SAMPLE = 1 << 20, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, verdict
Cut = tuple[str, str, int]  # key, path, row


def parse_rule(rule: str, verdict: str) -> Rule:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path, verdict


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, "\\.", -1))), F.lit(".")))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host and path columns of a url column; both empty where it is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Host:
    """The path prefixes of one host's rules, added in sorted order; each knows the next one around it."""

    def __init__(self, key: str):
        self.key = key
        self.paths: list[str] = []
        self.outer: list[int] = []
        self.best: list[tuple[int, int, str, str]] = []
        self.open: list[int] = []

    def add(self, path: str, host: str, verdict: str) -> None:
        name = host + path
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        around = self.open[-1] if self.open else -1
        best = (len(name), len(host), verdict, name)
        self.paths.append(path)
        self.outer.append(around)
        self.best.append(max(best, self.best[around]) if around >= 0 else best)
        self.open.append(len(self.paths) - 1)

    def longest(self, path: str) -> tuple[int, int, str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.best[i] if i >= 0 else None


def _part_of_urls(batches: Iterator[pa.RecordBatch], cuts: Sequence[Cut]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [bisect_right(cuts, x) for x in zip(*(b.column(c).to_pylist() for c in ("key", "path", "row")))]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *b.columns], names=["part", *b.schema.names])


def _parts_of_rules(batches: Iterator[pa.RecordBatch], cuts: Sequence[Cut]) -> Iterator[pa.RecordBatch]:
    """A rule for each range that may hold keys from its own up to where keys no longer begin with it (a slash follows a dot)."""
    for b in batches:
        rows, parts = [], []
        for i, key in enumerate(b.column("key").to_pylist()):
            own = range(bisect_left(cuts, (key,)), bisect_left(cuts, (key[:-1] + "/",)) + 1)
            parts += own
            rows += [i] * len(own)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(c.take(at) for c in b.columns)], names=["part", *b.schema.names])


def _swept(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of rules and urls, one after the other; the stack goes on from batch to batch."""
    stack: list[Host] = []
    part, last, got = -1, None, (None, default)
    for b in batches:
        urls, rules, verdicts = [], [], []
        for i, (p, key, is_url, path, host, verdict) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "host", "verdict")))):
            if p != part:
                stack, part, last = [], p, None
            if not is_url or (key, path) != last:
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
            if not is_url:
                if not stack or stack[-1].key != key:
                    stack.append(Host(key))
                stack[-1].add(path, host, verdict)
                continue
            if (key, path) != last:
                best = max((x for x in (h.longest(path) for h in stack) if x), default=None)
                last, got = (key, path), (best[3], best[2]) if best else (None, default)
            urls.append(i)
            rules.append(got[0])
            verdicts.append(got[1])
        if urls:
            held = [b.column(c).take(pa.array(urls, pa.int64())) for c in ("id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, keys: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """(keys, host, path, rule, verdict) of every row of pages; rules are a list or a table (host, path, verdict).

    The longest rule text wins (then the longer host, then the verdict that comes later in text order: block before allow).
    Null urls have empty host and path, fit no rule and get the default. Rules without a host fit nothing. Rows that repeat
    are judged alike; an empty table or no rules at all are fine; further columns are not read.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    host, path = host_and_path(url)
    urls = pages.select(F.struct(*keys).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    n = pages.count()
    parts = max(partitions(spark), min(CUT_SAMPLE // 8, -(-n // RANGE_URLS)))
    share = F.pmod(F.xxhash64("key", "path", "row"), F.lit(1 << 30)) / float(1 << 30)
    sample = sorted(map(tuple, urls.where(share < CUT_SAMPLE / max(1, n)).select("key", "path", "row").collect()))  # about CUT_SAMPLE rows
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    kind = urls.schema["id"].dataType.simpleString()
    names = "part int, key string, is_url boolean, path string, row long, host string, verdict string"
    table = urls.select("key", F.lit(True).alias("is_url"), "path", "row", "host", F.lit(None).cast("string").alias("verdict"), "id")
    table = table.mapInArrow(lambda it: _part_of_urls(it, cuts), f"{names}, id {kind}")
    known = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    known = known.select(host_key(F.col("host")).alias("key"), F.lit(False).alias("is_url"), "path", F.lit(0).cast("long").alias("row"), "host", "verdict", F.lit(None).cast(kind).alias("id"))
    table = table.unionByName(known.mapInArrow(lambda it: _parts_of_rules(it, cuts), f"{names}, id {kind}"))
    ranges = table.repartition(parts, "part").sortWithinPartitions("part", "key", "is_url", "path", "row")
    return ranges.mapInArrow(lambda it: _swept(it, default), f"id {kind}, host string, path string, rule string, verdict string").select("id.*", "host", "path", "rule", "verdict")
