"""The same filters and columns on a stream, and windows over event time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import filters as fl
from ..plans.engine import Engine


def stream_items(engine: Engine, name: str, stream: DataFrame, query: dict[str, str] | None = None) -> DataFrame:
    """Rows of a stream that a request on its collection lets through, with the columns of items().

    There is no order or page on a stream; limit, offset and next are refused. Joined tables are read as they
    are, the stream is the collection's own table. No state is kept.
    """
    refused = {"limit", "offset", "next"} & set(query or {})
    if refused:
        raise ValueError(f"not on a stream: {', '.join(sorted(refused))}")
    r = engine.bind(name, {**(query or {}), "limit": "-1"})
    c = r.collection
    live = replace(c, readers={**c.readers, c.table: lambda spark: stream})
    r.collection = live
    return engine.plan(r)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window start, key, n): rows a window of event time. Later ones than the watermark allows are left out."""
    marked = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counted = marked.groupBy(F.window("_at", window).alias("w"), F.col(key).alias(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def matching(stream: DataFrame, f: fl.Filter) -> DataFrame:
    return stream.filter(fl.to_column(f))
