"""SimHash near-duplicates by multi-index hashing.

Fingerprints within RADIUS = 2 bits are linked. A fingerprint is entered in SEGMENTS = 2 tables, one for
each 32-bit segment, under that segment's value. Two fingerprints within 2 bits differ by 1 bit at most in
one of the segments, so one of them finds the other in that segment's table when it looks up all members
of the Hamming ball of radius 1 around its own value; a ball's member is only looked up from the side that
has the lesser value, which finds each pair all the same. What the tables return is verified by the distance
of the whole fingerprints.

A segment's value that more than BUCKET fingerprints share is hot: its matches would grow with the square
of the group. There the lookup goes on into the other segment. Members of the bucket itself are entered
under every member of the ball of radius 1 in the other segment, where two within 2 bits meet, 33 at most
in one place; linking each with the one before it keeps all links' components without listing pairs. A
lookup from a neighbouring value leaves 1 bit for the other segment: 33 whole fingerprints are asked for.

Equal fingerprints are folded first. Components are found by checkpointed rounds on the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.util import checkpointed, connected_components, map_arrow, packed, unpacked

SHINGLE, SEED, RADIUS, BUCKET = 3, 42, 2, 128


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned; a bit is set if it is in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), seed=SEED)
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((xxh64_intdigest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for the text, with fp: the fingerprint as a signed long."""
    docs = docs.drop("fp")
    rest = [f for f in docs.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), pa.array(fps)], names=[*(f.name for f in rest), "fp"])

    return map_arrow(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "fp bigint"]))


def _ball(value, member) -> F.Column:
    """The members of the Hamming ball of radius 1 around a 32-bit value that ``member`` accepts (value, bit)."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return F.concat(F.array(value), F.transform(F.filter(bits, lambda b: member(value, b)), lambda b: value.bitwiseXOR(b)))


def _whole(seg, value, other) -> F.Column:
    """The fingerprint that has ``value`` in segment ``seg`` and ``other`` in the other one."""
    high, low = F.when(seg == 0, value).otherwise(other), F.when(seg == 0, other).otherwise(value)
    return F.call_function("shiftleft", high, F.lit(32)).bitwiseOR(low)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) of fingerprints within RADIUS bits that keep the components of all such pairs."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    entry = lambda seg, value, other: F.struct(F.lit(seg).alias("seg"), value.alias("value"), other.alias("other"))
    tables = distinct.select("fp", F.explode(F.array(entry(0, high, low), entry(1, low, high))).alias("e")).select("fp", "e.*")
    hot = checkpointed(tables.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("seg", "value"))
    up = _ball(F.col("value"), lambda v, b: v.bitwiseAND(b) == 0)  # a pair meets from the side that lacks the bit
    lookups = tables.select("fp", "seg", F.explode(up).alias("value"), "other", F.col("value").alias("own"))
    some = not hot.isEmpty()
    entered = tables.join(hot, ["seg", "value"], "left_anti") if some else tables
    met = lookups.join(entered.select("seg", "value", F.col("fp").alias("v")), ["seg", "value"]).select(F.col("fp").alias("u"), "v")
    if some:
        crowd = tables.join(hot, ["seg", "value"], "left_semi")
        ball = _ball(F.col("other"), lambda v, b: F.lit(True))
        spread = crowd.select("fp", F.explode(F.transform(ball, lambda x: _whole(F.col("seg"), F.col("value"), x))).alias("place"), "seg")
        before = F.lag("fp").over(W.partitionBy("seg", "place").orderBy("fp"))
        met = met.unionByName(spread.select(F.col("fp").alias("u"), before.alias("v")).where("v is not null"))
        near = lookups.where("value <> own").join(hot, ["seg", "value"], "left_semi")
        asked = near.select(F.col("fp").alias("u"), F.explode(F.transform(ball, lambda x: _whole(F.col("seg"), F.col("value"), x))).alias("v"))
        met = met.unionByName(asked.join(distinct.select(F.col("fp").alias("v")), "v").select("u", "v"))
    verified = met.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))
    return verified.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the least id that links reach; null ids are linked too, but are never the least. Null, empty
    and blank texts have fingerprint zero and are linked with each other. Repeated rows stay.
    """
    fps = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(least, "root").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the least id; of repeated rows of that id, all stay.

    Documents without an id stay.
    """
    columns = docs.columns
    lost = classes(docs, doc_id, text).where("doc_id <> component_id").select("doc_id").distinct()
    kept = packed(docs, "row", F.col(doc_id).alias("doc_id")).join(lost, "doc_id", "left_anti")
    return unpacked(kept, "row", columns)


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
