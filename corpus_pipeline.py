"""A corpus pipeline of five stages. Each reads what the one before kept, from Parquet in the shared folder.

The stages take whole documents and, but for the last, return the columns of documents. SQL can't express
the classifier and the random mixing, so ORACLE_SQL is None; tests hold the stages against brute force.

In all stages a null or empty text is a text without words, rows are documents by themselves, also where an id is
null, and an empty table stays empty. Documents may have more columns, of any name: they pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import decontaminate, mixing, near_dedup, quality, sharding
from terrane.llm.common import shared_folder, table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Repeated rows are scored one by one; without labels all score 0.5 and stay."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of 0.8 or more, stays: that with the least id.

    Of rows that share an id, the least stays; documents without words and rows with a null id all stay.
    """
    return near_dedup.deduplicated(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Documents without words and, without a benchmark, all documents stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or doubled, so that each source comes near its target.

    A null source is a source. Documents without words count nothing to a target; they are left out, kept or doubled at
    their source's rate. Of equal rows any may stand for the others.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard, by its id: equal ids share one, a null id has one of its own."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written to the shared folder and read again.

    What a stage has written goes once the next one is written. The table before the last stage stays, since the result
    reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
