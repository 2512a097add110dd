"""Vector functions as Column expressions, all inside the JVM; sums are kept in double precision.

A constant operand may be given as a list: it becomes an array literal and its norm is computed once,
in Python. Widths that are not known before the run are checked row by row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = Column | list


def column(v: Operand) -> Column:
    if isinstance(v, Column):
        return v
    return F.expr("cast(array(" + ", ".join(f"{float(np.float32(x))!r}D" for x in v) + ") as array<float>)")


def _fold(a: Operand, b: Operand, step, checked: bool) -> Column:
    x, y = column(a), column(b)
    total = F.aggregate(F.zip_with(x, y, step), F.lit(0.0), lambda s, v: s + v)
    if checked:
        return total
    return F.when(F.size(x) != F.size(y), F.raise_error(F.lit("VECTOR_WIDTHS"))).otherwise(total)


def dot_product(a: Operand, b: Operand, checked: bool = False) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"), checked)


def squared_l2_distance(a: Operand, b: Operand, checked: bool = False) -> Column:
    return _fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")), checked)


def l2_distance(a: Operand, b: Operand, checked: bool = False) -> Column:
    return F.sqrt(squared_l2_distance(a, b, checked))


def vector_norm(v: Operand) -> Column:
    if isinstance(v, Column):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.lit(math.sqrt(sum(float(np.float32(x)) ** 2 for x in v)))


def cosine_distance(a: Operand, b: Operand, checked: bool = False) -> Column:
    """1 - dot / norms, rounded to single precision; a zero vector on either side is an error."""
    norms = vector_norm(a) * vector_norm(b)
    value = (1 - dot_product(a, b, checked) / norms).cast("float").cast("double")
    return F.when(norms == 0, F.raise_error(F.lit("ZERO_NORM")).cast("double")).otherwise(value)


def normalize(v: Operand) -> Column:
    x, n = column(v), vector_norm(v)
    return F.when(n == 0, F.raise_error(F.lit("ZERO_NORM")).cast("array<float>")).otherwise(F.transform(x, lambda e: (e.cast("double") / n).cast("float")))


def vector_dims(v: Operand) -> Column:
    return F.when(column(v).isNotNull(), F.size(column(v)).cast("long"))
