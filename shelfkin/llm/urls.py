"""URLs against host and path rules by a sort-merge range join.

A host's labels turned round (``com.example.www.``) make a rule's host and all subdomains one
interval of keys. Rules and URLs are dealt to ranges of keys, a rule to every range its interval
touches. Each task sweeps its rows in key order: a rule is pushed on a stack when its interval
begins and popped when it ends, so the stack holds the nested rules around the present URL, and
the longest whose path begins the URL's wins (ties: the larger host, then block).

Range borders come from a bounded sample of keys and only balance the work. A key that makes up
several ranges has its URLs spread over them, so a host with a third of all rows is shared out.

Defined results: a null URL or one without ``://`` has empty host and path and no rule. Repeated
rules count once; a host or path that differs in nothing but its verdict blocks. Null ids and
repeated rows are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.shipping import ship

#: Keys looked at, about, to draw range borders.
SAMPLE = 20_000
_NO_PATH = -1
_RULE = "struct<host: string, path: string, verdict: string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in small letters (A to Z) and the path of a URL."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The labels turned round, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _borders(keys: DataFrame, rows: int, ranges: int, sample: int = SAMPLE) -> list[str]:
    """At most ``ranges - 1`` borders from about ``sample`` of ``rows`` keys; borders may repeat.

    Each task picks its share by itself, so the driver gets about ``sample`` keys at every size.
    """
    some = keys.select("key") if rows <= sample else keys.select("key").sample(sample / rows, 7)
    found = sorted(r.key for r in some.collect())
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []


def _range_of(borders: list[str]):
    def place(key: pa.Array, tie: pa.Array) -> pa.Array:
        out = []
        for k, t in zip(key.to_pylist(), tie.to_pylist(), strict=True):
            lo, hi = bisect.bisect_left(borders, k), bisect.bisect_right(borders, k)
            out.append(lo + t % (hi - lo + 1))
        return pa.array(out, pa.int32())

    return F.arrow_udf(place, "int")


def _ranges_of(borders: list[str]):
    def places(key: pa.Array) -> pa.Array:
        # Keys end with a dot; the first string beyond all that begin with a key ends with a slash.
        spans = [(bisect.bisect_left(borders, k), bisect.bisect_left(borders, k[:-1] + "/")) for k in key.to_pylist()]
        return pa.array([list(range(a, b + 1)) for a, b in spans], pa.list_(pa.int32()))

    return F.arrow_udf(places, "array<int>")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and key, a key's rules before its URLs."""
    stack: list[tuple[str, dict[str, str], list[int]]] = []
    at = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("range", "key", "rule_path", "verdict", "path")]
        keep, found, verdicts = [], [], []
        for i, (place, key, rule_path, verdict, path) in enumerate(zip(*columns, strict=True)):
            if place != at:
                stack, at = [], place
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule_path is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                if rule_path not in paths:
                    bisect.insort(lengths, len(rule_path))
                if paths.get(rule_path) != "block":
                    paths[rule_path] = verdict
                continue
            best = None
            for host, paths, lengths in stack:
                for n in reversed(lengths):
                    if path[:n] in paths and n <= len(path):
                        size = len(host) - 1 + n
                        if best is None or (size, len(host)) > best[0]:
                            best = (size, len(host)), host, path[:n], paths[path[:n]]
                        break
            keep.append(i)
            found.append(best and ".".join(reversed(best[1][:-1].split("."))) + best[2])
            verdicts.append(best and best[3])
        if keep:
            rows = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in ("page_id", "host", "path")] + [pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages(page_id, url)``; ``rules``
    has ``(host, path, verdict)`` with verdicts ``allow`` and ``block``. URLs that no rule fits get
    ``default``."""
    spark = pages.sparkSession
    ship(spark)
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("*", host_key(F.col("host")).alias("key"), F.pmod(F.hash("page_id", "path"), F.lit(1 << 30)).alias("tie"))
    borders = _borders(urls, pages.count(), ranges)
    dealt_urls = urls.select(
        _range_of(borders)("key", "tie").alias("range"), "key", F.lit(None).cast("string").alias("rule_path"),
        F.lit(None).cast("string").alias("verdict"), "page_id", "host", "path",
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    small = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = rules.select(host_key(small).alias("key"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").distinct()
    dealt_rules = keyed.select(
        F.explode(_ranges_of(borders)("key")).alias("range"), "key", "rule_path", "verdict",
        F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    rows = dealt_rules.unionByName(dealt_urls).repartition(ranges, "range")
    rows = rows.sortWithinPartitions("range", "key", F.col("rule_path").isNull())
    swept = rows.mapInArrow(_sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
