"""From raw documents to token ids: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, decontaminate, pii, simhash_dedup, toxicity
from sheaf.llm.util import shared_folder


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The documents with columns of an operator's own names under others, and how to select them back."""
    taken = {c: f"{c}\x00own" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(taken), [F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = _aside(docs, "score", "predicted")
    return toxicity.score(own, model).where("predicted = 0").select(back)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least id."""
    return simhash_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    own, back = _aside(docs, "matches")
    found = decontaminate.contained_items(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select(back)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and what discloses it, is replaced; every document stays."""
    return pii.sanitise(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text; columns of the new names are replaced."""
    return bpe.encoded(docs, bpe.default_vocabulary(), digests=True).drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither toxicity nor SimHash; tests hold each stage and run() against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet to the shared folder and read again.

    What a stage has written goes when the next one is written. The last one's folder is the result, which the caller reads, and
    deletes with the rest of the shared folder.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            _delete(spark, f"{base}/{k - 1}")
    return docs
