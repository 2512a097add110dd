"""From trees to DataFrames. The plan is declared; Catalyst chooses how it is run.

A ranked query with a LIMIT sorts by key expressions over the source's columns and projects after the
limit, so that Spark runs it as TakeOrderedAndProject: per-partition heaps on the key, payload columns
computed for the winners only. Distances from a constant get its norm as a literal, and Euclidean
distance is ranked by its square.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import errors as E
from quarry.functions import scalar
from quarry.functions import vector as V
from quarry.plans.analysis import AGGREGATES, DISTANCES, OPERATORS, UNARY_VECTOR, Scope, boolean, check_grouped, check_placement, constant, has_aggregate, type_of_expression
from quarry.plans.syntax import Array, Between, Binary, Call, Cast, Col, In, Is, Like, Lit, Node, Order, Paren, Select, Star, Unary, children, strip
from quarry.types import DOUBLE, INTEGER, Column, Type

ROWID = "_rowid"
TIE = "_tie"  # where a row of an attached table stands in its files
INT = (1 << 31) - 1


class Builder:
    """Builds Columns of expressions over a scope; `known` gives the columns of whole subexpressions (group keys, aggregates)."""

    def __init__(self, scope: Scope, name=lambda c, q: F.col(f"`{c.name}`"), known: dict | None = None):
        self.scope, self.name, self.known = scope, name, known or {}

    def type(self, e: Node) -> Type | None:
        return type_of_expression(e, self.scope)

    def predicate(self, e: Node) -> C:
        return self(e).cast("boolean")

    def __call__(self, e: Node) -> C:
        if self.known and (got := self.known.get(strip(e))) is not None:
            return got
        if isinstance(e, Lit):
            return F.lit(e.value)
        if isinstance(e, Col):
            return self.name(self.scope.find(e), e.parts[-2].lower() if len(e.parts) > 1 else "")
        if isinstance(e, Paren):
            return self(e.e)
        if isinstance(e, Unary):
            if e.op == "NOT":
                return ~self.predicate(e.e)
            v = constant(e)
            return F.lit(v) if v is not None else -self(e.e) if e.op == "-" else self(e.e)
        if isinstance(e, Binary):
            return self.binary(e)
        if isinstance(e, Is):
            x = self.predicate(e.e) if e.what is not None else self(e.e)
            test = x.isNull() if e.what is None else x.eqNullSafe(F.lit(e.what))
            return ~test if e.negated else test
        if isinstance(e, Between):
            x = self(e.e)
            test = (x >= self(e.low)) & (x <= self(e.high))
            return ~test if e.negated else test
        if isinstance(e, In):
            x, test = self(e.e), None
            values = [constant(i) for i in e.items]
            if None not in values and self.type(e.e) is not None and self.type(e.e).kind != "VECTOR":
                test = x.isin(values)
            else:
                for i in e.items:
                    one = x == self(i)
                    test = one if test is None else test | one
            return ~test if e.negated else test
        if isinstance(e, Like):
            pattern = e.pattern.value if isinstance(e.pattern, Lit) and isinstance(e.pattern.value, str) else self(e.pattern)
            test = scalar.like(self(e.e).cast("string"), pattern, e.fold)
            return ~test if e.negated else test
        if isinstance(e, Cast):
            return self(e.e).cast(e.to.spark)
        if isinstance(e, Array):
            v = constant(e)
            return V.column(v) if v is not None else F.array(*(self.element(x) for x in e.items))
        if isinstance(e, Call):
            return self.call(e)
        raise E.Unsupported(f"expression {e}")

    def element(self, e: Node) -> C:
        x = self(e).cast("float")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == scalar.INF), F.raise_error(F.lit("NON_FINITE_RESULT")).cast("float")).otherwise(x)

    def binary(self, e: Binary) -> C:
        if e.op == "AND":
            return self.predicate(e.a) & self.predicate(e.b)
        if e.op == "OR":
            return self.predicate(e.a) | self.predicate(e.b)
        if e.op in OPERATORS:
            return self.distance(OPERATORS[e.op], e.a, e.b)
        if e.op in "+-*/%":
            v = constant(e)
            if v is not None:
                return F.lit(v)
            t = self.type(e) or INTEGER
            a, b = (self(x).cast(t.spark) for x in (e.a, e.b))
            if e.op in "/%" and t == DOUBLE:
                return scalar.finite(a / b if e.op == "/" else a % b)
            if e.op == "/":
                return scalar.integer_divide(a, b)
            if e.op == "%":
                return scalar.remainder(a, b)
            out = a + b if e.op == "+" else a - b if e.op == "-" else a * b
            return scalar.finite(out) if t == DOUBLE else out
        a, b = self(e.a), self(e.b)
        return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[e.op](b)

    def operands(self, a: Node, b: Node) -> tuple:
        out = [constant(x) for x in (a, b)]
        out = [self(x).cast("array<float>") if v is None else v for x, v in zip((a, b), out)]
        if not any(isinstance(x, C) for x in out):
            out[0] = V.column(out[0])
        return tuple(out)

    def distance(self, name: str, a: Node, b: Node) -> C:
        x, y = self.operands(a, b)
        if name == "negative_dot_product":
            return -V.dot_product(x, y)
        return getattr(V, name)(x, y)

    def call(self, e: Call) -> C:
        if e.name == "vector":
            return self(Array(e.args))
        if e.name in DISTANCES:
            return self.distance(DISTANCES[e.name], *e.args)
        if e.name in UNARY_VECTOR:
            return {"dims": V.vector_dims, "norm": V.vector_norm, "normalize": V.normalize}[UNARY_VECTOR[e.name]](self(e.args[0]).cast("array<float>"))
        if e.name in AGGREGATES:
            return self.aggregate(e)
        raise E.Unsupported(f"function {e.name}")

    def aggregate(self, e: Call) -> C:
        if isinstance(e.args[0], Star):
            return F.count(F.lit(1))
        t, x = self.type(e.args[0]), self(e.args[0])
        if e.name == "count":
            return F.count_distinct(x) if e.distinct else F.count(x)
        if e.name == "sum":
            x = x.cast((t or INTEGER).spark)
            total = F.sum_distinct(x) if e.distinct else F.sum(x)
            return scalar.finite(total) if t == DOUBLE else total
        if e.name == "avg":
            x = x.cast("double")
            return F.expr("1").cast("double") * F.avg(x) if not e.distinct else F.sum_distinct(x) / F.count_distinct(x)
        return F.min(x) if e.name == "min" else F.max(x)


def rank_key(e: Node) -> Node:
    """What to sort by instead of e: the square of a Euclidean distance orders alike."""
    x = e.e if isinstance(e, Paren) else e
    if isinstance(x, Call) and DISTANCES.get(x.name) == "l2_distance":
        return Call("squared_l2_distance", x.args)
    if isinstance(x, Binary) and x.op == "<->":
        return Call("squared_l2_distance", (x.a, x.b))
    return e


@dataclass
class Output:
    """A projected expression with its label and type."""

    e: Node
    label: str
    type: Type | None


@dataclass
class Checked:
    """A SELECT that has passed all static checks."""

    select: Select
    columns: list[Column]
    outputs: list[Output]
    order: list[tuple[Order, Node]]
    aggregate: bool
    limit: int | None
    offset: int
    scope: Scope = field(repr=False)


def count_of(e: Node | None, what: str) -> int | None:
    if e is None:
        return None
    v = constant(e)
    if isinstance(v, bool) or not isinstance(v, int) or v < 0:
        raise E.InvalidQuery(f"{what} must be a non-negative integer")
    return v


def check(select: Select, columns: list[Column]) -> Checked:
    """All static checks of a SELECT over a table's columns."""
    scope = Scope(columns)
    check_placement(select)
    if select.where is not None:
        boolean(type_of_expression(select.where, scope))
    outputs = []
    for item in select.items:
        if isinstance(item.e, Star):
            if select.table is None:
                raise E.InvalidQuery("a wildcard needs a table")
            outputs += [Output(Col((c.name,), c.name), c.name, c.type) for c in columns]
        else:
            label = item.alias or (item.e.name if isinstance(item.e, Col) else str(item.e))
            outputs.append(Output(item.e, label, type_of_expression(item.e, scope)))
    keys = {strip(g) for g in select.group}
    for g in select.group:
        type_of_expression(g, scope)
    aggregate = bool(select.group) or any(has_aggregate(o.e) for o in outputs) or select.having is not None and has_aggregate(select.having)
    if select.having is not None:
        if not aggregate:
            raise E.InvalidQuery("HAVING requires GROUP BY or an aggregate expression")
        boolean(type_of_expression(select.having, scope))
        check_grouped(select.having, keys)
    order = []
    for o in select.order:
        e = o.e
        if isinstance(e, Col) and len(e.parts) == 1:
            e = next((x.e for x in outputs if x.label.lower() == e.name.lower()), e)
        if has_aggregate(e) and not aggregate:
            raise E.InvalidQuery("an aggregate in ORDER BY needs an aggregate query")
        t = type_of_expression(e, scope)
        if t is not None and t.kind == "VECTOR":
            raise E.TypeMismatch("sortable scalar value", t.in_messages)
        order.append((o, e))
    if aggregate:
        for x in outputs:
            check_grouped(x.e, keys)
        for _, e in order:
            check_grouped(e, keys)
    limit, offset = count_of(select.limit, "LIMIT"), count_of(select.offset, "OFFSET") or 0
    if limit is not None and limit + offset > (1 << 63) - 1:
        raise E.InvalidQuery("OFFSET plus LIMIT is too large")
    return Checked(select, columns, outputs, order, aggregate, limit, offset, scope)


def paged(df: DataFrame, c: Checked, keys: list[C], rows: int | None = None) -> DataFrame:
    """LIMIT and OFFSET of rows sorted by keys; `rows` is the most there can be, where that is known.

    Spark takes 32 bits. Numbers beyond that need the rows counted in order, in one task, unless there are fewer rows.
    """
    limit, offset = c.limit, c.offset
    if rows is not None:
        limit = None if limit is not None and limit >= rows else limit
        if offset >= rows:
            return df.limit(0)
    if offset <= INT and (limit is None or limit <= INT):
        df = df.offset(offset) if offset else df
        return df.limit(limit) if limit is not None else df
    place = F.count(F.lit(1)).over(Window.orderBy(*(keys or [F.monotonically_increasing_id()])).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (F.col("_place") > offset) & (F.col("_place") <= (offset + limit if limit is not None else (1 << 63) - 1))
    df = df.withColumn("_place", place).filter(inside)
    return df.orderBy("_place") if keys else df


def keys_of(c: Checked, build: Builder, ranked: bool = True) -> list[C]:
    return [scalar.order_key(build(rank_key(e) if ranked else e), bool(o.desc), o.nulls_first) for o, e in c.order if constant(e) is None]


def named(c: Checked, build: Builder) -> list[C]:
    return [build(x.e).cast(x.type.spark).alias(x.label) if x.type else build(x.e).alias(x.label) for x in c.outputs]


def to_frame(c: Checked, spark: SparkSession, source: DataFrame | None, rows: int | None = None, in_order: bool = False) -> DataFrame:
    """The DataFrame of a checked SELECT; `rows` is the number of the source's rows, where it is known.

    Rows that no ORDER BY sorts are sorted by insertion where a LIMIT asks for it, or else with `in_order`.
    """
    df = source if source is not None else spark.range(1).withColumnRenamed("id", ROWID)
    build = Builder(c.scope)
    if c.select.where is not None:
        df = df.filter(build.predicate(c.select.where))
    rowid = ROWID in df.columns
    if c.aggregate:
        return _aggregated(c, df, build, rowid, rows)
    if c.select.distinct:
        return _distinct(c, df, build, rowid, rows, in_order)
    keys = keys_of(c, build)
    if rowid and (keys or c.limit is not None or c.offset or in_order):
        keys.append(F.col(ROWID).asc())
    elif TIE in df.columns and keys:
        keys.append(F.col(TIE).asc())
    if keys:
        df = df.orderBy(*keys)
    return paged(df, c, keys, rows).select(*named(c, build))


def _calls(e: Node) -> list[Call]:
    if isinstance(e, Call) and e.name in AGGREGATES:
        return [e]
    return [x for ch in children(e) for x in _calls(ch)]


def _aggregated(c: Checked, df: DataFrame, build: Builder, rowid: bool, rows: int | None) -> DataFrame:
    groups = {strip(g): build(g).alias(f"_g{i}") for i, g in enumerate(c.select.group)}
    every = [x.e for x in c.outputs] + [e for _, e in c.order] + ([c.select.having] if c.select.having is not None else [])
    calls = {strip(a): a for e in every for a in _calls(e)}
    aggs = [build.aggregate(a).alias(f"_a{i}") for i, a in enumerate(calls.values())]
    first = [F.min(ROWID).alias("_first")] if rowid and groups else []
    aggs = aggs or [F.count(F.lit(1)).alias("_n")]
    df = df.groupBy(*groups.values()).agg(*aggs, *first) if groups else df.agg(*aggs)
    known = {g: F.col(f"_g{i}") for i, g in enumerate(groups)} | {a: F.col(f"_a{i}") for i, a in enumerate(calls)}
    after = Builder(c.scope, known=known)
    if c.select.having is not None:
        df = df.filter(after.predicate(c.select.having))
    if c.select.distinct:
        return _distinct(c, df.withColumn(ROWID, F.col("_first")) if first else df, after, bool(first), rows)
    keys = keys_of(c, after, False)
    if first:
        keys.append(F.col("_first").asc())
    if keys:
        df = df.orderBy(*keys)
    return paged(df, c, keys, max(rows, 1) if rows is not None else None).select(*named(c, after))


def _distinct(c: Checked, df: DataFrame, build: Builder, rowid: bool, rows: int | None, in_order: bool = False) -> DataFrame:
    """The first of equal rows; sorting may use what is not projected."""
    out = named(c, build)
    names = [f"_o{i}" for i in range(len(out))]
    keys = [(o, build(e)) for o, e in c.order if constant(e) is None]
    plain = {strip(x.e) for x in c.outputs} >= {strip(e) for _, e in c.order}
    df = df.select(*(x.alias(n) for x, n in zip(out, names)), *(k.alias(f"_k{i}") for i, (_, k) in enumerate(keys)), *([F.col(ROWID)] if rowid else []))
    if plain:  # equal rows have equal keys: a plain aggregation finds the first
        df = df.groupBy(*names, *(f"_k{i}" for i in range(len(keys)))).agg(*([F.min(ROWID).alias(ROWID)] if rowid else [F.lit(0).alias("_one")]))
    else:
        tie = F.col(ROWID) if rowid else F.struct(*(f"_k{i}" for i in range(len(keys))))
        df = df.withColumn("_i", F.row_number().over(Window.partitionBy(*names).orderBy(tie))).filter("_i = 1")
    sort = [scalar.order_key(F.col(f"_k{i}"), bool(o.desc), o.nulls_first) for i, (o, _) in enumerate(keys)]
    if rowid and (sort or c.limit is not None or c.offset or in_order):
        sort.append(F.col(ROWID).asc())
    if sort:
        df = df.orderBy(*sort)
    return paged(df, c, sort, max(rows, 1) if rows is not None else None).select(*(F.col(n).alias(x.label) for n, x in zip(names, c.outputs)))
