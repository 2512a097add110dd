"""Tables of the catalog and the writes on them.

A table is an immutable version. A small one holds its rows on the driver (at most LOCAL of them, a
fixed bound). A larger one is a list of Parquet folders in the shared folder, each with an edition
number, and a list of marks: folders whose row ids are dead in what is older. A write evaluates its
change once, into one new folder, validates that folder against the present version and publishes a
version with the folder added: INSERT adds rows, DELETE adds marks, UPDATE and upserts add the new
rows under their old ids, which are marks too. What is there already is not written again, until a
quarter of the rows is dead or there are many folders. `_rowid` keeps insertion order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import errors as E
from quarry.plans.analysis import Scope
from quarry.plans.compile import ROWID, Builder
from quarry.plans.syntax import Col, Conflict
from quarry.sources.scratch import drop_scratch, materialise, scratch_path
from quarry.types import Column, coerce, struct_of

LOCAL = 32_768
FOLDERS = 64
EDITION = "_edition"
RESERVED = {ROWID, EDITION}


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    rows: tuple | None = ()  # with _rowid last
    frame: DataFrame | None = None
    count: int = 0
    next_id: int = 0
    read_only: bool = False
    placed: DataFrame | None = None  # of an attached table: its frame with the place of each row
    parts: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    edition: int = 0
    dead: int = 0
    looked_up: tuple[str, ...] = ()  # columns whose folders get Bloom filters: unique and indexed ones

    def find(self, name: str) -> Column:
        return Scope(list(self.columns)).find(Col((name,)))

    def data(self, spark: SparkSession) -> DataFrame:
        """The table's frame; that of rows on the driver is made once a version, by way of Arrow."""
        if self.frame is not None:
            return self.frame
        held = self.__dict__.get("_held")
        if held is None or held.sparkSession is not spark:
            held = spark.createDataFrame(self.arrow(), struct_of(list(self.columns)))
            object.__setattr__(self, "_held", held)
        return held

    def arrow(self) -> pa.Table:
        kinds = {"INTEGER": pa.int64(), "DOUBLE": pa.float64(), "TEXT": pa.string(), "BOOLEAN": pa.bool_(), "VECTOR": pa.list_(pa.float32())}
        columns = list(zip(*self.rows)) if self.rows else [()] * (len(self.columns) + 1)
        return pa.table([pa.array(x, kinds[c.type.kind]) for x, c in zip(columns, self.columns)] + [pa.array(columns[-1], pa.int64())], [*(c.name for c in self.columns), ROWID])


def key(value):
    return tuple(value) if isinstance(value, list) else value


def named(column: Column | str):
    return F.col(f"`{column if isinstance(column, str) else column.name}`")


# --- folders ---------------------------------------------------------------------------------------


def read_parts(columns, parts, marks, spark: SparkSession) -> DataFrame:
    """The living rows of some folders: an id counts in its newest edition only, and not where a later mark has it."""
    frame = spark.read.schema(struct_of(list(columns)).add(EDITION, "long")).parquet(*parts)
    if marks:
        gone = spark.read.schema(f"{ROWID} long, {EDITION} long").parquet(*marks).select(F.col(ROWID).alias("_gone"), F.col(EDITION).alias("_since"))
        frame = frame.join(gone, (F.col(ROWID) == F.col("_gone")) & (F.coalesce(EDITION, F.lit(0)) < F.col("_since")), "left_anti")
    return frame.drop(EDITION)


def write_part(table: Table, df: DataFrame, edition: int) -> str:
    path = scratch_path(df.sparkSession, f"table-{table.name}")
    out = df.withColumn(EDITION, F.lit(edition).cast("long")).write
    for name in {*table.looked_up, *(c.name for c in table.columns if c.unique)} & set(df.columns):
        if table.find(name).type.kind not in ("VECTOR", "BOOLEAN"):
            out = out.option(f"parquet.bloom.filter.enabled#{name}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    out.parquet(path)
    return path


def compacted(table: Table, spark: SparkSession) -> Table:
    """The same rows in one folder."""
    part = write_part(table, table.data(spark), table.edition + 1)
    return replace(table, rows=None, parts=(part,), marks=(), edition=table.edition + 1, dead=0, frame=read_parts(table.columns, (part,), (), spark))


@dataclass
class Change:
    """Rows that have been evaluated once: a list where both sides are small, else a folder."""

    table: Table
    frame: DataFrame
    rows: list | None
    path: str | None

    @classmethod
    def of(cls, table: Table, df: DataFrame, small: bool) -> Change:
        names = [c.name for c in table.columns]
        if set(names) <= set(df.columns):
            df = df.select(*(named(c).cast(c.type.spark).alias(c.name) for c in table.columns), F.col(ROWID).cast("long").alias(ROWID))
        if small:
            rows = [tuple(r) for r in df.orderBy(ROWID).collect()]
            return cls(table, df.sparkSession.createDataFrame(rows, df.schema), rows, None)
        path = write_part(table, df, table.edition + 1)
        return cls(table, df.sparkSession.read.schema(df.schema).parquet(path), None, path)

    def facts(self, unique: list[Column] = ()) -> dict:
        """How many rows, how many of them bear ids of before, the largest id; NOT NULL is checked, and that no
        value of the unique columns comes twice (nulls are distinct)."""
        must = [(i, c) for i, c in enumerate(self.table.columns) if not c.nullable and c.name in self.frame.columns]
        old = self.table.next_id
        if self.rows is not None:
            empty = [sum(r[i] is None for r in self.rows) for i, _ in must]
            n, known, top = len(self.rows), sum(r[-1] < old for r in self.rows), max((r[-1] for r in self.rows), default=-1)
            keys = [[key(r[self.table.columns.index(c)]) for r in self.rows] for c in unique]
            again = [len(x) - x.count(None) - len(set(x) - {None}) for x in keys]
        else:
            n, known, top, *more = self.frame.agg(
                F.count("*"), F.count_if(F.col(ROWID) < old), F.coalesce(F.max(ROWID), F.lit(-1)), *(F.count_if(named(c).isNull()) for _, c in must), *(F.count(named(c)) - F.count_distinct(named(c)) for c in unique),
            ).first()
            empty, again = more[: len(must)], more[len(must) :]
        for kind, found in ((E.NullViolation, [(c, k) for (_, c), k in zip(must, empty)]), (E.UniqueViolation, zip(unique, again))):
            for c, k in found:
                if k:
                    self.drop()
                    raise kind(c.name)
        return {"n": n, "old": known, "top": top}

    def drop(self) -> None:
        if self.path:
            drop_scratch(self.frame.sparkSession, self.path)

    def check_unique(self, columns: list[Column], others: list | DataFrame) -> None:
        """No value of these columns is in the rows that the change leaves as they are."""
        for c in columns:
            if self.rows is not None and isinstance(others, list):
                i = self.table.columns.index(c)
                twice = {key(r[i]) for r in others if r[i] is not None} & {key(r[i]) for r in self.rows}
            else:  # a change that is small goes to the rows, wherever they are
                twice = not others.select(named(c).alias("_o")).join(self.frame.select(named(c).alias("_k")), F.col("_o") == F.col("_k"), "left_semi").isEmpty()
            if twice:
                self.drop()
                raise E.UniqueViolation(c.name)


def settled(table: Table, change: Change, facts: dict, spark: SparkSession, kind: str) -> Table:
    """The next version; kind tells if the change adds rows, replaces rows of the same ids, or only marks them."""
    count = table.count - facts["n"] if kind == "marks" else table.count + facts["n"] - facts["old"]
    next_id = max(table.next_id, facts["top"] + 1)
    if count <= LOCAL:
        ids = {r[-1] for r in change.rows} if change.rows is not None else None
        if table.frame is None and ids is not None:
            rows = [r for r in table.rows if r[-1] not in ids] + ([] if kind == "marks" else change.rows)
        else:
            now = table.data(spark).join(change.frame.select(F.col(ROWID).alias("_gone")), F.col(ROWID) == F.col("_gone"), "left_anti")
            now = now if kind == "marks" else now.unionByName(change.frame)
            rows = [tuple(r) for r in now.collect()]
            change.drop()
        return replace(table, rows=tuple(sorted(rows, key=lambda r: r[-1])), frame=None, parts=(), marks=(), dead=0, count=len(rows), next_id=next_id)
    if table.frame is None:
        table = compacted(table, spark) if table.rows else replace(table, edition=table.edition + 1)
        if change.path is None or (table.parts and kind != "rows"):  # marks hold for older editions only
            change = replace_change(change, table)
    parts = table.parts if kind == "marks" else (*table.parts, change.path)
    marks = table.marks if kind == "rows" else (*table.marks, change.path)
    dead = table.dead + (facts["n"] if kind == "marks" else facts["old"])
    out = replace(table, rows=None, frame=read_parts(table.columns, parts, marks, spark), parts=parts, marks=marks, edition=table.edition + 1, dead=dead, count=count, next_id=next_id)
    return compacted(out, spark) if dead * 4 > count or len(parts) + len(marks) > FOLDERS else out


def replace_change(change: Change, table: Table) -> Change:
    """The change as a folder of the edition after the table's."""
    path = write_part(table, change.frame, table.edition + 1)
    change.drop()
    return Change(table, change.frame, None, path)


# --- rows that come in -----------------------------------------------------------------------------


def incoming(table: Table, rows, spark: SparkSession, ordered: bool = False) -> DataFrame:
    """A batch with its order: a list of rows in schema order, or a DataFrame with the table's columns (with `ordered`, and `_ord`)."""
    if ordered:
        return rows
    if isinstance(rows, DataFrame):
        by_name = {n.lower(): n for n in rows.columns}
        missing = [c.name for c in table.columns if c.name.lower() not in by_name]
        if missing:
            raise E.ColumnNotFound(missing[0])
        return rows.select(*(named(by_name[c.name.lower()]).cast(c.type.spark).alias(c.name) for c in table.columns), F.monotonically_increasing_id().alias("_ord"))
    struct = struct_of(list(table.columns), False).add("_ord", "long")
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], struct)


def coerced(table: Table, rows) -> list[tuple]:
    out = []
    for r in rows:
        if len(r) != len(table.columns):
            raise E.InvalidQuery(f"expected {len(table.columns)} values, found {len(r)}")
        out.append(tuple(coerce(v, c.type) for v, c in zip(r, table.columns)))
        for v, c in zip(out[-1], table.columns):
            if v is None and not c.nullable:
                raise E.NullViolation(c.name)
    return out


def writable(table: Table) -> Table:
    if table.read_only:
        raise E.InvalidQuery(f"table '{table.name}' is read-only")
    return table


def is_small(table: Table, rows) -> bool:
    return table.frame is None and not isinstance(rows, DataFrame) and table.count + len(rows) <= LOCAL


def insert(table: Table, rows, conflict: Conflict | None, spark: SparkSession, ordered: bool = False) -> tuple[Table, int]:
    """Appends a batch under a conflict policy; all or nothing."""
    writable(table)
    target = None
    if conflict and conflict.target:
        target = table.find(conflict.target)
        if not target.unique:
            raise E.InvalidQuery(f"conflict target '{conflict.target}' is not unique")
    if conflict and conflict.assignments is not None:
        if target is None:
            raise E.InvalidQuery("DO UPDATE requires a conflict target")
        return _upsert(table, rows, target, conflict, spark, ordered)
    if is_small(table, rows):
        return _insert_local(table, rows, conflict, target)
    batch, scratch = incoming(table, rows, spark, ordered), []
    if conflict:
        batch = _without_conflicts(table, batch, [target] if target else [c for c in table.columns if c.unique], spark, scratch)
    change = Change.of(table, _numbered(batch, table), False)
    drop_scratch(spark, *scratch)
    unique = [c for c in table.columns if c.unique and not (conflict and target in (None, c))]
    facts = change.facts(unique)
    if not facts["n"]:
        change.drop()
        return table, 0
    if table.count:
        change.check_unique(unique, table.data(spark))
    return settled(table, change, facts, spark, "rows"), facts["n"]


def _numbered(batch: DataFrame, table: Table) -> DataFrame:
    return batch.withColumn(ROWID, F.col("_ord") + table.next_id).drop("_ord")


def _insert_local(table: Table, rows, conflict, target) -> tuple[Table, int]:
    watched = [(i, c) for i, c in enumerate(table.columns) if c.unique]
    seen = {i: {key(r[i]) for r in table.rows if r[i] is not None} for i, _ in watched}
    skip = [i for i, c in watched if conflict and (target is None or c.name == target.name)]
    new, n = [], table.next_id
    for r in rows:
        if any(key(r[i]) in seen[i] for i in skip if r[i] is not None):
            continue
        for i, c in watched:
            if r[i] is not None:
                if key(r[i]) in seen[i]:
                    raise E.UniqueViolation(c.name)
                seen[i].add(key(r[i]))
        new.append((*r, n))
        n += 1
    return replace(table, rows=table.rows + tuple(new), count=table.count + len(new), next_id=n), len(new)


def _without_conflicts(table: Table, batch: DataFrame, columns: list[Column], spark: SparkSession, scratch: list[str]) -> DataFrame:
    """The rows that conflict neither with stored nor with accepted earlier ones.

    Which rows win depends on the order of all before them: in each round the rows that are the first of
    all their keys are accepted, and those that share a key with one of them are out. The first row left
    is always accepted; most batches take one round.
    """
    batch, path = materialise(batch, "batch")
    scratch.append(path)
    keys = [f"_k{i}" for i in range(len(columns))]
    left = batch.select("_ord", *(named(c).alias(k) for c, k in zip(columns, keys)))
    if table.count:
        data = table.data(spark)
        for c, k in zip(columns, keys):
            left = left.join(data.select(named(c).alias("_o")), F.col(k) == F.col("_o"), "left_anti")
    rounds = []
    while True:
        left, path = materialise(left, "undecided")
        scratch.append(path)
        firsts = left
        for k in keys:
            least = left.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_o")).agg(F.min("_ord").alias(f"_first{k}"))
            firsts = firsts.join(least, F.col(k) == F.col("_o"), "left").drop("_o")
        accepted = firsts.filter(reduce(lambda a, b: a & b, (F.coalesce(F.col(f"_first{k}") == F.col("_ord"), F.lit(True)) for k in keys), F.lit(True)))
        accepted, path = materialise(accepted.select("_ord", *keys), "accepted")
        scratch.append(path)
        rounds.append(accepted.select("_ord"))
        left = left.join(accepted.select("_ord"), "_ord", "left_anti")
        for k in keys:
            left = left.join(accepted.select(F.col(k).alias("_o")), F.col(k) == F.col("_o"), "left_anti")
        if left.isEmpty():
            return batch.join(reduce(DataFrame.union, rounds), "_ord", "left_semi")


def _upsert(table: Table, rows, target: Column, conflict: Conflict, spark: SparkSession, ordered: bool) -> tuple[Table, int]:
    """Updates rows of equal key, adds the others; a row may be touched once only."""
    small = is_small(table, rows)
    scope = Scope(list(table.columns), {"excluded": list(table.columns)})
    build = Builder(scope, lambda c, q: F.col(f"{'i' if q == 'excluded' else 't'}.`{c.name}`"))
    sets = assignments(table, conflict.assignments, build)
    batch, scratch = incoming(table, rows, spark, ordered), []
    if not small:
        batch, path = materialise(batch, "batch")
        scratch.append(path)
    k = f"`{target.name}`"
    i = table.columns.index(target)
    given = [key(r[i]) for r in rows if r[i] is not None] if not isinstance(rows, DataFrame) else None
    if len(set(given)) != len(given) if given is not None else not batch.filter(F.col(k).isNotNull()).groupBy(k).count().filter("count > 1").isEmpty():
        raise E.InvalidQuery("ON CONFLICT DO UPDATE cannot affect a row a second time")
    both = table.data(spark).alias("t").join(batch.alias("i"), F.col(f"t.{k}") == F.col(f"i.{k}"))
    hit = F.coalesce(build.predicate(conflict.where), F.lit(False)) if conflict.where is not None else F.lit(True)
    cols = [(sets[c.name] if c.name in sets else F.col(f"t.`{c.name}`")).alias(c.name) for c in table.columns]
    matched = both.select(*cols, F.col(f"t.{ROWID}").alias(ROWID), F.col("i._ord").alias("_ord"), hit.alias("_hit"))
    if not small:
        matched, path = materialise(matched, "matched")
        scratch.append(path)
    new = _numbered(batch.join(matched.select("_ord"), "_ord", "left_anti"), table) if table.count else _numbered(batch, table)
    change = Change.of(table, matched.filter("_hit").drop("_hit", "_ord").unionByName(new), small)
    drop_scratch(spark, *scratch)
    unique = [c for c in table.columns if c.unique]
    facts = change.facts(unique)
    if not facts["n"]:
        change.drop()
        return table, 0
    _check_replaced(table, change, unique, spark)
    return settled(table, change, facts, spark, "both"), facts["n"]


def _check_replaced(table: Table, change: Change, columns: list[Column], spark: SparkSession) -> None:
    """Uniqueness of a change against the rows whose ids it does not bear."""
    if not columns or not table.count:
        return
    if table.frame is None and change.rows is not None:
        ids = {r[-1] for r in change.rows}
        change.check_unique(columns, [r for r in table.rows if r[-1] not in ids])
    else:
        others = table.data(spark).join(change.frame.select(F.col(ROWID).alias("_gone")), F.col(ROWID) == F.col("_gone"), "left_anti")
        change.check_unique(columns, others)


def assignments(table: Table, pairs, build: Builder) -> dict:
    """Column by name of what is assigned, types checked."""
    out = {}
    for name, e in pairs:
        c = table.find(name)
        if c.name in out:
            raise E.DuplicateColumn(c.name)
        t = build.type(e)
        if t is not None and t != c.type and not (t.kind == "INTEGER" and c.type.kind == "DOUBLE"):
            if t.kind == c.type.kind == "VECTOR":
                raise E.DimensionMismatch(c.type.dims, t.dims)
            raise E.TypeMismatch(c.type.in_messages, t.in_messages)
        out[c.name] = build(e).cast(c.type.spark)
    return out


def update(table: Table, pairs, where, spark: SparkSession) -> tuple[Table, int]:
    """Right sides see the old row."""
    writable(table)
    build = Builder(Scope(list(table.columns)))
    sets = assignments(table, pairs, build)
    data = table.data(spark)
    if where is not None:
        data = data.filter(build.predicate(where))
    cols = [sets[c.name].alias(c.name) if c.name in sets else named(c) for c in table.columns]
    change = Change.of(table, data.select(*cols, ROWID), table.frame is None)
    unique = [c for c in table.columns if c.unique and c.name in sets]
    facts = change.facts(unique)
    if not facts["n"]:
        change.drop()
        return table, 0
    _check_replaced(table, change, unique, spark)
    return settled(table, change, facts, spark, "both"), facts["n"]


def delete(table: Table, where, spark: SparkSession) -> tuple[Table, int]:
    writable(table)
    data = table.data(spark)
    if where is not None:
        data = data.filter(Builder(Scope(list(table.columns))).predicate(where))
    change = Change.of(table, data.select(ROWID), table.frame is None)
    facts = change.facts()
    if not facts["n"]:
        change.drop()
        return table, 0
    return settled(table, change, facts, spark, "marks"), facts["n"]
