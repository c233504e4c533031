"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes in a part of a table that is written, of the order at which Spark joins small partitions.
PART_BYTES = 4_000_000
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Where that is unset and Spark runs in this process alone (tests, a laptop), a temporary folder that goes with
    the process. On a cluster without the setting: RuntimeError, since other machines would not see such a folder.
    """
    sc = spark.sparkContext
    if known := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="terrane-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return _made[0]


def checkpointed(df: DataFrame, size: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    size: about how many bytes the table has, if that is known; then it is written in parts of about PART_BYTES,
    not in as many files as there are shuffle partitions.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if size is None else in_parts(df, size)).checkpoint(eager=True)


def in_parts(df: DataFrame, size: int) -> DataFrame:
    """df in as many partitions as so many bytes need, if it has more."""
    return df.coalesce(max(1, -(-size // PART_BYTES)))


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() would also change letters outside ASCII."""
    return F.translate(c, UPPER, LOWER)


def fresh(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about so many bytes together; one text is never cut."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    begin, total = 0, 0
    for i, x in enumerate(size.tolist()):
        if total and total + x > most:
            yield begin, i
            begin, total = i, 0
        total += x
    if begin < len(size):
        yield begin, len(size)


def every(columns: list[str]) -> list[Column]:
    """The columns by name, whatever their names have in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def plainly_named(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ... and the new name of each: functions over Arrow don't take all names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
