"""Shared pieces of the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, one process on one machine, as in tests, a temporary folder is
    made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="sheaf-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def packed(df: DataFrame, row: str, *own: Column) -> DataFrame:
    """All columns of ``df`` as one, of the name ``row``, beside an operator's own: these can't clash with them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(row), *own)


def unpacked(df: DataFrame, row: str, columns: Sequence[str], *own: Column | str) -> DataFrame:
    """The columns again, then the operator's own."""
    return df.select(*(F.col(f"`{row}`.`{c}`") for c in columns), *own)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more fields after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def lean() -> None:
    """A worker's Arrow memory goes back to the system when it is freed, since the worker lives on through all stages."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())


#: What a worker keeps from task to task: one thing at most, by its key.
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable):
    """What ``make`` gave when the worker last needed it under this key; ``map_arrow`` must be told the key, too."""
    if key not in _KEPT:
        release(key)
        _KEPT[key] = make()
    return _KEPT[key]


def release(but: Hashable = None) -> None:
    """Drop what the worker keeps under other keys, and give the memory back to the system."""
    if not _KEPT.keys() - {but}:
        return
    for key in _KEPT.keys() - {but}:
        del _KEPT[key]
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f: Callable, schema, keeps: Hashable = None) -> DataFrame:
    """``mapInArrow`` for columns of any name, as Spark itself can't pass on those with a dot, in little memory.

    keeps: the key of what ``f`` keeps in the worker; what other operators kept there goes, since the worker lives on
    through all stages.
    """
    names = df.columns

    def run(batches: Iterator) -> Iterator:
        lean()
        release(keeps)
        return f(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def slices(texts: Sequence[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` characters, one row at least."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def fold_ascii(column) -> F.Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node that it reaches.

    Alternating large-star and small-star steps: every step replaces edges by edges to a nearer
    minimum, so that each component ends as a star. Groups are only folded with min(), which is
    combined before the shuffle, and joined back by key; the minima are written first, so that both
    sides of that join are plain exchanges, which Spark splits where a key is hot. No node's
    neighbours are ever gathered. Each round is checkpointed. A path of n nodes takes about log n
    rounds; RuntimeError after ``most_rounds``.
    """
    links = edges.select("u", "v").where("u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = checkpointed(links)
    seen = None
    for _ in range(most_rounds):
        # large-star: the larger neighbours of each node move to the least in its neighbourhood
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        # small-star: a node and its smaller neighbours move to the least of them
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = checkpointed(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.unionByName(roots)
