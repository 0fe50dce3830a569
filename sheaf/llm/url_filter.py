"""URL filters as a sort-merge range join.

A rule (host, path) covers its host and all subdomains. Written with its labels reversed, each
followed by NUL, a host becomes a key under which all its subdomains form one interval of the sort
order, and the intervals of several rules nest or are disjoint. URLs and rules are sorted together by
that key; a sweep keeps the stack of the rules whose interval is open, and the longest rule on it
whose path starts the URL's path decides.

The sort is dealt by ranges of (key, salt), so a host or a URL that holds a third of all rows is cut
into several ranges. The ranges' ends are quantiles of a sample whose size follows from the number of
ranges. A rule is sent, as a row, to every range that its interval meets, so each sweep begins with the
rules that are open there; all others go to one range only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.util import fold_ascii, packed, unpacked, with_fields

#: Rows sampled for each range, to cut the sorted line into ranges of like size.
SAMPLED = 40

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add host and path; both are empty where the URL is null or has no ``://``."""
    at = F.instr(F.col(url), "://")
    after = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return df.withColumns(
        {
            "host": fold_ascii(F.regexp_extract(after, r"^[^/?#]*", 0)),
            "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def host_key(host) -> F.Column:
    """Labels reversed, each followed by NUL: a host's subdomains start with its key."""
    return F.array_join(F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(x, F.lit("\0"))), "")


class Stack:
    """The open intervals; each holds its rules by path."""

    def __init__(self, default: str):
        self.default, self.frames = default, []

    def close_until(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def open(self, key: str, host: str, path: str, action: str) -> None:
        self.close_until(key)
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, {}, set()))
        _, paths, lengths = self.frames[-1]
        paths[path] = (host, action)
        lengths.add(len(path))

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        self.close_until(key)
        best, found = (-1, -1), (None, self.default)
        for _, paths, lengths in self.frames:
            for n in lengths:
                if n <= len(path) and (rule := paths.get(path[:n])):
                    rank = (len(rule[0]) + n, len(rule[0]))
                    if rank > best:
                        best, found = rank, (rule[0] + path[:n], rule[1])
        return found


def url_filter(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``urls`` with host, path, rule and verdict.

    ``rules`` has host, path and action. The longest fitting rule wins (the length of host and path
    together, then that of the host). No fitting rule: rule is null and verdict is ``default``. A null
    URL has an empty host and path, which no rule fits. Repeated rows stay. Input columns of the four
    names are replaced, any others stay as they are. Of rules with equal host and path one is used, the one whose action sorts last;
    rules with a null part or an empty host are void. An empty table gives no rows.
    """
    spark = urls.sparkSession
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rules = rules.where("host <> '' and path is not null and action is not null")
    rules = rules.groupBy(fold_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("action").alias("action"))
    rules = rules.withColumn("key", host_key(F.col("rule_host")))
    dealt = split_url(packed(urls.select(*(F.col(f"`{c}`") for c in keep)), "row", F.col(url).alias("url")), "url")
    dealt = dealt.select("row", "host", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int").alias("salt"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = split_url(urls.select(F.col(url).alias("url")), "url").select(host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int").alias("salt"))
    few = few.orderBy(F.xxhash64("salt", "key")).limit(SAMPLED * ranges).collect()  # SAMPLED for each range
    line = sorted((r["key"], r["salt"]) for r in few)
    ends = sorted({line[k * len(line) // ranges] for k in range(1, ranges)}) if line else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(ends, x) for x in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist())]
            yield batch.append_column("range", pa.array(at, pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # all keys that begin with a rule's key lie between it and the key with its last NUL made greater
            spans = [(bisect_left(ends, (k, -1)), bisect_left(ends, (k[:-1] + "\x01", -1))) for k in batch.column("key").to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [y - x + 1 for x, y in spans])
            yield batch.take(pa.array(rows)).append_column("range", pa.array([r for x, y in spans for r in range(x, y + 1)], pa.int32()))

    dealt = dealt.mapInArrow(deal, with_fields(dealt, "range int"))
    rules = rules.withColumn("salt", F.lit(-1))
    rules = rules.mapInArrow(spread, with_fields(rules, "range int"))
    events = dealt.unionByName(rules, allowMissingColumns=True)
    events = events.repartitionByRange(ranges, "range").sortWithinPartitions("range", "key", "salt")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, now = Stack(default), None
        for batch in batches:
            salts, keys, paths, places = (batch.column(c).to_pylist() for c in ("salt", "key", "path", "range"))
            is_url, found = [], []
            for k, (salt, key) in enumerate(zip(salts, keys)):
                if places[k] != now:
                    stack, now = Stack(default), places[k]
                is_url.append(salt >= 0)
                if salt >= 0:
                    found.append(stack.judge(key, paths[k]))
                else:
                    stack.open(key, *(batch.column(c)[k].as_py() for c in ("rule_host", "rule_path", "action")))
            own = batch.select(["row", "host", "path"]).filter(pa.array(is_url, pa.bool_()))
            columns = [*own.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "host", "path", "rule", "verdict"])

    swept = events.mapInArrow(sweep, with_fields(dealt.select("row", "host", "path"), "rule string, verdict string"))
    return unpacked(swept, "row", keep, "host", "path", "rule", "verdict")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = url_filter(pages, spark.createDataFrame(RULES, "host string, path string, action string"))
    return found.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, act) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(act, length(rh || rp)) AS act
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
