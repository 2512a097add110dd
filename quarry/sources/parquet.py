"""Parquet tables as read-only tables of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.tables import Table
from quarry.plans.compile import TIE
from quarry.types import BOOLEAN, DOUBLE, INTEGER, TEXT, Column, vector

KINDS = {T.ByteType: INTEGER, T.ShortType: INTEGER, T.IntegerType: INTEGER, T.LongType: INTEGER, T.FloatType: DOUBLE, T.DoubleType: DOUBLE, T.DecimalType: DOUBLE, T.StringType: TEXT, T.BooleanType: BOOLEAN}


def attach(name: str, df: DataFrame, dims: dict[str, int] | None = None, place=None) -> Table:
    """A read-only table over a DataFrame; array columns need their width, columns of other types are left out.

    Nothing is read here: the frame stays a plan, and filters and columns reach the scan. `place` tells
    where a row stands; only queries that rank rows read it, to put equal ones in that order.
    """
    dims, columns, out = dims or {}, [], []
    for f in df.schema.fields:
        kind = KINDS.get(type(f.dataType))
        if isinstance(f.dataType, T.ArrayType) and f.name in dims:
            kind = vector(dims[f.name])
        if kind is not None:
            columns.append(Column(f.name, kind))
            out.append(F.col(f"`{f.name}`").cast(kind.spark).alias(f.name) if f.dataType.simpleString() != kind.spark.simpleString() else F.col(f"`{f.name}`"))
    return Table(name, tuple(columns), None, df.select(*out), -1, 0, True, placed=df.select(*out, place.alias(TIE)) if place is not None else None)


def attach_path(spark: SparkSession, name: str, path: str, dims: dict[str, int] | None = None) -> Table:
    """Rows keep the order of their files, by name, and of the rows within."""
    return attach(name, spark.read.parquet(path), dims, F.struct("_metadata.file_path", "_metadata.row_index"))
