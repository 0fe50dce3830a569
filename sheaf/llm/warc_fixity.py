"""Fixity audit of WARC replicas with Merkle trees.

A record's leaf hashes the SHA-256 of its bytes with its place: file, offset and length. The node of
level l over ids n*16^l .. (n+1)*16^l-1 hashes its at most 16 children in order together with the byte
range that they cover, from the first one's offset on, so a node certifies one ordered range of the
archive. Two replicas are compared from the root; only children of differing nodes are looked at, until
the differing records are known. A record whose bytes agree, but whose place in its file has moved, as
behind a lost one, lies in a differing branch and is told apart there by its own digest.

Each level is written once, sixteen times smaller than the one below, and read for the level above and
for the descent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.util import checkpointed

FANOUT, SHARD = 16, 1024  # powers of two: floor division is a shift


def record_bytes(record_id: str, uri: str, payload: str) -> F.Column:
    """A WARC/1.1 resource record as text; a null URI or payload counts as empty."""
    uri, body = F.coalesce(F.col(uri), F.lit("")), F.coalesce(F.col(payload), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col(record_id).cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """(record_id, shard, offset, length, digest) from rows (record_id, bytes), one for each id.

    Files hold the records of SHARD successive ids in order; offset is the place in the file. Rows that share an
    id make one record: its digest is over their number and the sums of their digests' eight parts, whatever
    their order, and its length is their sum, so no group of rows is gathered. Rows with a null id can't be
    addressed and are left out; a null body is an empty record. Other columns are ignored.
    """
    body = F.coalesce(F.col("bytes"), F.lit(""))
    each = records.where("record_id is not null").select(F.col("record_id").cast("long").alias("record_id"), F.sha2(body, 256).alias("d"), F.octet_length(body).cast("long").alias("n"))
    part = lambda k: F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    one = each.groupBy("record_id").agg(F.sum("n").alias("length"), F.count("*").alias("k"), F.min("d").alias("d"), *(F.sum(part(k)).alias(f"s{k}") for k in range(8)))
    whole = F.sha2(F.concat_ws(",", F.col("k").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(8))), 256)
    one = one.select("record_id", F.shiftright(F.col("record_id").cast("long"), SHARD.bit_length() - 1).alias("shard"), "length", F.when(F.col("k") == 1, F.col("d")).otherwise(whole).alias("digest"))
    before = W.partitionBy("shard").orderBy("record_id").rowsBetween(W.unboundedPreceding, -1)  # SHARD rows at most
    return one.select("record_id", "shard", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "digest")


def level_up(nodes: DataFrame) -> DataFrame:
    """Nodes (node, hash, offset, length) of the next level; a group has at most FANOUT rows."""
    children = F.sort_array(F.collect_list(F.struct("node", "hash", "offset", "length")))
    up = nodes.groupBy(F.shiftright("node", FANOUT.bit_length() - 1).alias("parent")).agg(children.alias("c"), F.sum("length").alias("length"))
    joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["offset"].cast("string"), x["length"].cast("string"), x["hash"])), ",")
    return up.select(F.col("parent").alias("node"), F.sha2(joined, 256).alias("hash"), F.element_at("c", 1)["offset"].alias("offset"), "length")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """The leaves of replica ``a``, and those that only ``b`` has, with b_digest and status.

    status is ok, corrupt (digests differ), missing (not in b) or extra (not in a). Records in branches
    with equal hashes are ok without having been compared themselves. Ids may be negative; empty
    replicas give the other's rows as missing or extra.
    """
    names = ["record_id", "shard", "offset", "length", "digest"]
    a, b = checkpointed(a.select(names)), checkpointed(b.select(names))
    leaf = F.sha2(F.concat_ws(":", F.col("shard").cast("string"), F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest")), 256)
    trees = [[x.select(F.col("record_id").alias("node"), leaf.alias("hash"), "offset", "length")] for x in (a, b)]
    ends = a.select("record_id").unionByName(b.select("record_id")).agg(F.min("record_id"), F.max("record_id")).first()
    low, high = ends[0] or 0, ends[1] or 0
    while low != high:  # floor division: the least and the greatest node of each level, until it is one
        low, high = low // FANOUT, high // FANOUT
        if (low, high) == (-1, 0):  # negative ids and others never meet under one node: two roots
            high = low
        for tree in trees:
            tree.append(checkpointed(level_up(tree[-1])))

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.select("node", F.col("hash").alias("ha")).join(y.select("node", F.col("hash").alias("hb")), "node", "full")
        return checkpointed(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node"))

    bad = differing(trees[0][-1], trees[1][-1])
    for level in range(len(trees[0]) - 2, -1, -1):
        parents = bad.select(F.col("node").alias("parent"))
        bad = differing(*(t[level].withColumn("parent", F.shiftright("node", FANOUT.bit_length() - 1)).join(parents, "parent", "left_semi") for t in trees))
    bad = bad.withColumnRenamed("node", "record_id").withColumn("looked", F.lit(True))
    other = b.join(bad, "record_id", "left_semi").select("record_id", F.col("digest").alias("found"))
    known = a.join(bad, "record_id", "left").join(other, "record_id", "left")
    known = known.withColumn("b_digest", F.when(F.col("looked").isNull(), F.col("digest")).otherwise(F.col("found")))
    known = known.withColumn("status", F.expr("CASE WHEN b_digest IS NULL THEN 'missing' WHEN b_digest = digest THEN 'ok' ELSE 'corrupt' END"))
    extra = b.join(bad, "record_id", "left_semi").join(a.join(bad, "record_id", "left_semi"), "record_id", "left_anti")
    extra = extra.withColumns({"b_digest": F.col("digest"), "digest": F.lit(None).cast("string"), "status": F.lit("extra")})
    return known.select(*names, "b_digest", "status").unionByName(extra.select(*names, "b_digest", "status"))


def op2_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every page is a record; the second replica lost each 389th and has one byte more in each 97th."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    damaged = pages.where("page_id % 389 <> 1").withColumn("html", F.when(F.col("page_id") % 97 == 2, F.concat(F.coalesce("html", F.lit("")), F.lit("."))).otherwise(F.col("html")))
    sides = [leaves(x.select(F.col("page_id").alias("record_id"), record_bytes("page_id", "url", "html").alias("bytes"))) for x in (pages, damaged)]
    return audit(*sides).withColumnRenamed("record_id", "page_id")


OP2_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, CASE WHEN page_id % 97 = 2 THEN coalesce(html, '') || '.' ELSE coalesce(html, '') END AS h2 FROM pages
), w AS (
  SELECT page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(h2) || chr(13) || chr(10) || chr(13) || chr(10) || h2 || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM r
)
SELECT page_id, page_id // 1024 AS shard,
  coalesce(sum(strlen(a)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  strlen(a)::BIGINT AS length, sha256(a) AS digest, CASE WHEN page_id % 389 <> 1 THEN sha256(b) END AS b_digest,
  CASE WHEN page_id % 389 = 1 THEN 'missing' WHEN page_id % 97 = 2 THEN 'corrupt' ELSE 'ok' END AS status
FROM w
"""
