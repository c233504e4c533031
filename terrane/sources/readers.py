"""Where tables come from. Each reader gives a DataFrame; Spark does pruning and pushdown."""

from __future__ import annotations

import datetime as dt
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.geometry import read_wkb, read_wkt, write_wkb
from ..plans.properties import TYPES, Property, coerce

Reader = Callable[[SparkSession], DataFrame]


def parquet(path: str) -> Reader:
    return lambda spark: spark.read.parquet(path)


def files(kind: str, path: str, schema: str, **options: str) -> Reader:
    """CSV, JSON or ORC files with a given schema."""
    return lambda spark: spark.read.format(kind).schema(schema).options(**options).load(path)


def table(name: str) -> Reader:
    return lambda spark: spark.table(name)


def frame(df: DataFrame) -> Reader:
    return lambda spark: df


def jdbc(url: str, dbtable: str, fetch: int = 250, column: str = "", low: str = "", high: str = "", parts: int = 1, **options: str) -> Reader:
    """A database table, in ranges of a column if one is given; filters and columns go to the database."""

    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, fetchsize=str(fetch), **options)
        if column:
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(parts))
        return reader.load()

    return read


def memory(properties: list[Property], rows: list[str]) -> Reader:
    """Rows of text as in a test configuration: values by property, parted by semicolons; null for no value."""
    fields = [(p.column or p.name, p.kind) for p in properties]

    def read(spark: SparkSession) -> DataFrame:
        made = []
        for row in rows:
            values = row.split(";")
            if len(values) != len(fields):
                raise ValueError(f"{len(fields)} values are needed: {row!r}")
            made.append(
                tuple(
                    None if v == "null" else write_wkb(read_wkt(v)) if k == "geometry" else coerce(k, v)
                    for v, (_, k) in zip(values, fields, strict=True)
                )
            )
        return spark.createDataFrame(made, ", ".join(f"`{n}` {TYPES[k]}" for n, k in fields))

    return read


_SQLITE = {
    "BOOLEAN": "boolean", "TINYINT": "int", "SMALLINT": "int", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "FLOAT": "float",
    "DOUBLE": "double", "REAL": "double", "DATE": "date", "DATETIME": "timestamp",
}


def geopackage(path: str, name: str, batch: int = 10_000) -> Reader:
    """A feature table of a GeoPackage file on the driver, geometry as WKB.

    One primary key and one geometry column are needed. SQLite is a file for one machine: rows are read in
    batches, and a table that doesn't fit the driver belongs into Parquet first (see to_parquet).
    """

    def read(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for rows in geopackage_rows(path, name, batch) for r in rows], geopackage_schema(path, name)[0])

    return read


def geopackage_schema(path: str, name: str) -> tuple[str, str, str, int]:
    """(DDL, primary key, geometry column, srid) of a feature table."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = db.execute(f'PRAGMA table_info("{name}")').fetchall()
        geometry = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchall()
    keys = [c[1] for c in columns if c[5]]
    if len(keys) != 1 or len(geometry) != 1:
        raise ValueError(f"{name}: one primary key and one geometry column are needed")
    ddl = []
    for _, column, kind, *_ in columns:
        base = kind.split("(")[0].upper()
        ddl.append(f"`{column}` " + ("binary" if column == geometry[0][0] else _SQLITE.get(base, "string")))
    return ", ".join(ddl), keys[0], geometry[0][0], geometry[0][1]


def geopackage_rows(path: str, name: str, batch: int = 10_000):
    """Lists of rows with values as the schema has them."""
    ddl, _, geometry, _ = geopackage_schema(path, name)
    fields = [(x.rsplit(" ", 1)[0].strip("`"), x.rsplit(" ", 1)[1]) for x in ddl.split(", ")]

    def value(v, column: str, kind: str):
        if v is None:
            return None
        if column == geometry:
            return write_wkb(read_wkb(v))
        if kind == "boolean":
            return bool(v)
        if kind == "date":
            return dt.date.fromisoformat(v)
        if kind == "timestamp":
            return dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
        return float(v) if kind in ("float", "double") else v

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT " + ", ".join(f'"{c}"' for c, _ in fields) + f' FROM "{name}"')
        while got := rows.fetchmany(batch):
            yield [tuple(value(v, c, k) for v, (c, k) in zip(r, fields, strict=True)) for r in got]


def to_parquet(spark: SparkSession, path: str, name: str, target: str, batch: int = 100_000) -> None:
    """A GeoPackage table of any size to Parquet, batch by batch."""
    ddl = geopackage_schema(path, name)[0]
    for i, rows in enumerate(geopackage_rows(path, name, batch)):
        spark.createDataFrame(rows, ddl).write.mode("append" if i else "overwrite").parquet(target)


def empty(ddl: str) -> Reader:
    return lambda spark: spark.createDataFrame([], ddl)
