"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of `share` times all words, by weight, at most `most` times its own
words; what is cut off is shared again by weight among the others until none is above its bound.
Every document of a source is taken floor(target / source words) times. For the rest of the budget
the documents are counted by exact length: each length gives its proportional share, a greedy pass
takes the rest down to a small remainder, and a bounded-knapsack table over the lengths that are left
fits that remainder exactly wherever a sum does. If none does, picks are undone for wider tables. Within a length, documents are selected by a seeded
hash.

Skew: the plan is made from counts by length, never from documents. Selecting k of n documents of one
length cuts each group into 1024 ranges of the hash; whole ranges are in or out by their counts, and
only the one range where the k-th lies is ranked. What documents are joined with has one row per source
and length.

Defined cases: null text has no words; null is a source of its own, after all others; a null doc_id is
taken like any other; very long texts count like others (lengths beyond the table too); repeated rows are documents of their own; sources without words have target 0
and take nothing; empty documents are copied like the rest of their source, adding nothing; an empty
table gives an empty result; reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, batched, join_texts, materialise, text_bytes, units, whole_row

TABLE = 1 << 16  # the remainder that the first knapsack table is made for
WIDEST = 1 << 26  # and the last one, 0.3 GB
RANGES = 1 << 10  # of the selecting hash


def word_counts(it):
    for b in units(it, "text", 1 << 20):
        buf, at = join_texts(b.column("text").to_pylist())
        sp = SPACE[np.frombuffer(b"\n" + buf, np.uint8)]
        first = (sp[:-1] & ~sp[1:]).astype(np.int64)
        n = np.diff(np.append(0, np.cumsum(first))[np.append(at, len(first))]) if len(first) else np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, pa.array(n, pa.int64())], [*(c for c in b.schema.names if c != "text"), "size"])


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE, seed: int = 0, widest: int = WIDEST) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget, from below, as can be found.

    Where a table misses the budget, proportional picks are undone for one four times as wide, until a sum is exact,
    the table holds the whole budget (then no sum is nearer) or it would be beyond `widest`.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    unit = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    best, undo = None, 0
    while True:
        take = _fit(lengths, counts, budget, total, table, undo, seed)
        if best is None or (take * lengths).sum() > (best * lengths).sum():
            best = take
        if (best * lengths).sum() == budget or table >= budget or table >= widest:
            return best
        table = min(4 * max(table, 1), max(widest, table))
        undo = table


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, total: int, table: int, undo: int, seed: int) -> np.ndarray:
    """fit_budget with one table; proportional picks are made for the budget less `undo`."""
    take = np.zeros(len(lengths), np.int64)
    left = budget
    if budget > table:
        take = np.array([int(c) * (budget - undo) // total for c in counts.tolist()], np.int64)
        left -= int((take * lengths).sum())
        order = np.random.Generator(np.random.PCG64(seed)).permutation(len(lengths))
        while left > table:
            before = left
            for i in order:
                if take[i] < counts[i] and 0 < lengths[i] <= left - table // 2:
                    take[i] += 1
                    left -= int(lengths[i])
                    if left <= table:
                        break
            if left == before:  # each length that is free is over left - table / 2: at most one more document fits
                fits = np.flatnonzero((lengths > 0) & (lengths <= left) & (take < counts))
                if len(fits):
                    i = fits[np.argmax(lengths[fits])]
                    take[i] += 1
                    left -= int(lengths[i])
                break
    cap = min(left, max(table, 1))
    # bounded knapsack: first[r] is the first item with which the sum r can be reached
    items = []
    for i in np.flatnonzero((lengths > 0) & (lengths <= cap) & (take < counts)):
        n, k = min(int(counts[i] - take[i]), cap // int(lengths[i])), 1
        while n > 0:
            items.append((int(lengths[i]) * min(k, n), int(i), min(k, n)))
            n -= k
            k *= 2
    first = np.full(cap + 1, -1, np.int32)
    reach = np.zeros(cap + 1, bool)
    reach[0] = True
    for j, (w, _, _) in enumerate(items):
        if reach[cap]:
            break
        new = reach[:-w] & ~reach[w:] if w <= cap else np.zeros(0, bool)
        first[w:][new] = j
        reach[w:] |= new
    r = int(np.flatnonzero(reach)[-1])
    while r:
        w, i, k = items[first[r]]
        take[i] += k
        r -= w
    return take


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `rank`, their place by key, nulls last: ranges are sorted apart, and one count a range comes to the driver."""
    spark = rows.sparkSession
    order = F.col(key).asc_nulls_last()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)  # the upper bits are the partition's number
    counts = rows.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    first, before = [], 0
    for x in counts:
        first.append((x["part"], before))
        before += x["n"]
    first = F.broadcast(spark.createDataFrame(first, "part int, before long"))
    return rows.join(first, part.cast("int") == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before", "place")


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, one row each) with rank-dealt weight and target; one row per source, not per document."""
    dealt = F.array(*(F.lit(float(w)) for w in weights))
    ranked = materialise(numbered(sources, "source").withColumn("weight", F.get(dealt, (F.col("rank") % len(weights)).cast("int"))).drop("rank"), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    budget = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = None, -1
    while True:  # each round caps at least one source more; only sums come to the driver
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        x = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(above.cast("int")).alias("n")).first()
        if x["n"] is None or x["n"] == capped or not x["weight"]:
            break
        level, capped = (budget - x["fixed"]) / x["weight"], x["n"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level if level is not None else 0.0), cap))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 13) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, tag (a hash of the text) of every row of docs (doc_id, text, source)."""
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_bytes()).alias("tag"), text_bytes().alias("text"))
    sizes = base.mapInArrow(word_counts, "doc_id long, source string, tag long, size long")
    hashed = F.xxhash64(F.lit(seed), "doc_id", "tag")
    sizes = materialise(sizes.withColumn("h", hashed).withColumn("range", F.shiftrightunsigned("h", 54).cast("int")), "sizes")
    source_rows = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("long")
    source_rows = source_rows.withColumn("whole", whole).withColumn("budget", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # counts by length: one row per source and length
    lengths = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    join = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    lengths = lengths.join(source_rows.select(F.col("source").alias("s"), "budget"), join("source", "s")).drop("s")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        take = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]), seed=seed)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "k": take})

    picks = lengths.groupBy("source").applyInPandas(plan, "source string, size long, n long, k long").filter("k > 0")
    picks = materialise(picks.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "k"), "picks")
    on_length = join("source", "s") & (F.col("size") == F.col("z"))
    # of n documents of a length k are taken: all of the ranges before the one with the k-th, none of those behind it, `quota` of its m
    ranges = sizes.groupBy("source", "size", "range").agg(F.count("*").alias("m")).join(picks.filter("k < n").drop("n"), on_length)
    upto = F.sum("m").over(W.partitionBy("s", "z").orderBy("range"))
    cut = ranges.withColumn("upto", upto).filter("upto >= k and upto - m < k").select("s", "z", F.col("range").alias("r"), (F.col("k") - F.col("upto") + F.col("m")).alias("quota"), "m")
    every = picks.filter("k = n").select("s", "z", F.lit(RANGES).alias("r"), F.lit(0).cast("long").alias("quota"), F.lit(0).cast("long").alias("m"))
    cuts = materialise(cut.unionByName(every), "cuts")  # one row per source and length
    split = F.coalesce((F.col("range") == F.col("r")) & (F.col("quota") < F.col("m")), F.lit(False))
    taken = F.coalesce((F.col("range") < F.col("r")) | ((F.col("range") == F.col("r")) & (F.col("quota") == F.col("m"))), F.lit(False))
    clear = sizes.join(cuts, on_length, "left").filter(~split).withColumn("extra", taken.cast("int"))
    ranked = sizes.join(cuts, on_length).filter(split).withColumn("i", F.row_number().over(W.partitionBy("source", "size", "range").orderBy("h", "doc_id", "tag")))
    ranked = ranked.withColumn("extra", (F.col("i") <= F.col("quota")).cast("int"))
    cols = ["doc_id", "source", "tag", "size", "extra"]
    chosen = clear.select(*cols).unionByName(ranked.select(*cols))
    out = chosen.join(source_rows.select(F.col("source").alias("s"), "source_size", "target", "whole"), join("source", "s"))
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "tag")


def repeat_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns, whatever their names."""
    plan = mix_sources(docs, **how).groupBy("doc_id", "tag").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    plan = plan.select(F.col("doc_id").alias("id"), F.col("tag").alias("tag"), "copies")
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_bytes()).alias("own_tag"), whole_row(docs).alias("row"))
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["own_id", "own_tag"])  # their copies have been summed
    rows = rows.join(plan, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_tag") == F.col("tag")))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
