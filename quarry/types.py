"""Logical types of the dialect and their Spark types."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from quarry import errors as E

MAX_DIMENSIONS = 65535
I64 = (-(1 << 63), (1 << 63) - 1)


@dataclass(frozen=True)
class Type:
    kind: str  # INTEGER, DOUBLE, TEXT, BOOLEAN, VECTOR
    dims: int = 0

    def __str__(self):
        return f"VECTOR({self.dims})" if self.kind == "VECTOR" else self.kind

    @property
    def in_messages(self) -> str:
        return "FLOAT" if self.kind == "DOUBLE" else str(self)

    @property
    def numeric(self) -> bool:
        return self.kind in ("INTEGER", "DOUBLE")

    @property
    def spark(self) -> T.DataType:
        return {"INTEGER": T.LongType(), "DOUBLE": T.DoubleType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "VECTOR": T.ArrayType(T.FloatType(), True)}[self.kind]


INTEGER, DOUBLE, TEXT, BOOLEAN = Type("INTEGER"), Type("DOUBLE"), Type("TEXT"), Type("BOOLEAN")


def vector(dims: int) -> Type:
    if dims < 1:
        raise E.InvalidVectorDimension()
    if dims > MAX_DIMENSIONS:
        raise E.VectorDimensionLimit(dims, MAX_DIMENSIONS)
    return Type("VECTOR", dims)


# fixed values: accepted spellings
SPELLINGS = {
    INTEGER: "TINYINT INT2 SMALLINT MEDIUMINT INT INT4 INT64 INTEGER BIGINT INT8",
    DOUBLE: "FLOAT FLOAT4 FLOAT64 REAL FLOAT8 DOUBLE NUMERIC DECIMAL DEC",
    TEXT: "TEXT STRING CHARACTER CHAR VARCHAR NVARCHAR",
    BOOLEAN: "BOOL BOOLEAN",
}
BY_NAME = {name: t for t, names in SPELLINGS.items() for name in names.split()}


@dataclass(frozen=True)
class Column:
    name: str
    type: Type
    nullable: bool = True
    unique: bool = False
    comment: str | None = None


def coerce(value, to: Type):
    """A Python value as one of the type: identity, integer to double, null; anything else is a mismatch."""
    if value is None:
        return None
    kind = type_of(value)
    if kind == to:
        return [float(x) for x in value] if to.kind == "VECTOR" else value
    if kind == INTEGER and to == DOUBLE:
        return float(value)
    if kind.kind == to.kind == "VECTOR":
        raise E.DimensionMismatch(to.dims, kind.dims)
    raise E.TypeMismatch(to.in_messages, kind.in_messages)


def type_of(value) -> Type:
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        if not I64[0] <= value <= I64[1]:
            raise E.InvalidQuery("integer literal is out of range")
        return INTEGER
    if isinstance(value, float):
        if not math.isfinite(value):
            raise E.InvalidQuery("numeric value is not finite")
        return DOUBLE
    if isinstance(value, str):
        return TEXT
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        check_vector(value)
        return vector(len(value))
    raise E.TypeMismatch("a value of the dialect", type(value).__name__)


def check_vector(value) -> None:
    import struct

    if set(map(type, value)) == {float}:  # at once; what is wrong is found one by one
        with np.errstate(over="ignore"):
            if np.isfinite(np.array(value).astype(np.float32)).all():
                return
    for i, x in enumerate(value):
        if isinstance(x, bool) or not isinstance(x, (int, float)) and not hasattr(x, "item"):
            raise E.TypeMismatch("numeric vector element", "NULL" if x is None else type(x).__name__)
        try:
            struct.pack("<f", x)
        except (OverflowError, struct.error):
            raise E.NonFiniteVectorElement(i) from None
        if not math.isfinite(x):
            raise E.NonFiniteVectorElement(i)


def struct_of(columns: list[Column], rowid: bool = True) -> T.StructType:
    fields = [T.StructField(c.name, c.type.spark, True, {"vector_dims": c.type.dims} if c.type.dims else {}) for c in columns]
    return T.StructType(fields + [T.StructField("_rowid", T.LongType(), False)] * rowid)
