"""Exact dedup with a log-structured merge index.

Each task is a memtable: it groups texts by their bytes, and when it holds `memtable_bytes` of texts and
identifiers (copies count too) it flushes a sorted run: per digest the staying identifier, the number of rows and the member ids, cut
into segments by digest prefix, each segment with a Bloom filter. Runs are written to the shared
folder. Compaction merges the segments of a prefix, smallest first; the filter of the larger segment
decides which digests are looked up in it at all. A digest found in more than one entry is a hit, and
the texts of its entries' representatives are compared byte for byte; should digests ever agree
where bytes differ, those groups are formed anew by the bytes.

Skew: copies of one text are collapsed within a run before anything is shuffled, so a group of any
size has at most one entry per run. Members are joined back by digest, which AQE may split.

Defined cases: null text counts as empty, and empty texts equal each other; a null doc_id stays only
where its group has no other id; of rows repeated with one id exactly one is kept; a text longer than
a memtable is a run of its own; an empty table gives an empty result; other columns are ignored, and
`keep_one` passes them on under any name.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batched, materialise, text_bytes, units, whole_row

NONE = -(1 << 63)  # the score of a null id: below all others
RUNS = "run long, bucket int, digest binary, best long, n long, ids array<long>, segment binary, filter binary"


class Bloom:
    """A Bloom filter of ten bits a key over digests; built and asked by arrays."""

    HASHES = 4

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, digests: np.ndarray) -> Bloom:
        out = cls(np.zeros(max(8, len(digests) * 10 // 8 + 1), np.uint8))
        for at in out._at(digests):
            np.bitwise_or.at(out.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        return out

    def _at(self, digests: np.ndarray):
        width = digests.dtype.itemsize
        raw = np.zeros((len(digests), 16), np.uint8)
        raw[:, : min(16, width)] = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, width)[:, :16]
        a, b = raw.view("<u8")[:, 0], raw.view("<u8")[:, 1] | np.uint64(1)
        for i in range(self.HASHES):
            yield (a + np.uint64(i) * b) % np.uint64(len(self.bits) * 8)

    def may_have(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for at in self._at(digests):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


class Segment:
    """Sorted digests of a run (or of merged runs) with best score, its run, rows and entries of each."""

    def __init__(self, digests, best, run, n, entries, bloom=None):
        self.digests, self.best, self.run, self.n, self.entries = digests, best, run, n, entries
        self.bloom = bloom or Bloom.of(digests)

    def __len__(self):
        return len(self.digests)

    def merge(self, other: Segment) -> Segment:
        """self is the larger one; its filter spares look-ups."""
        ask = np.flatnonzero(self.bloom.may_have(other.digests))
        at = np.searchsorted(self.digests, other.digests[ask])
        at = np.minimum(at, len(self) - 1)
        found = self.digests[at] == other.digests[ask]
        mine, theirs = at[found], ask[found]
        better = (other.best[theirs] > self.best[mine]) | ((other.best[theirs] == self.best[mine]) & (other.run[theirs] < self.run[mine]))
        self.best[mine] = np.where(better, other.best[theirs], self.best[mine])
        self.run[mine] = np.where(better, other.run[theirs], self.run[mine])
        self.n[mine] += other.n[theirs]
        self.entries[mine] += other.entries[theirs]
        new = np.ones(len(other), bool)
        new[theirs] = False
        cols = [np.concatenate([x, y[new]]) for x, y in ((self.digests, other.digests), (self.best, other.best), (self.run, other.run), (self.n, other.n), (self.entries, other.entries))]
        order = np.argsort(cols[0], kind="stable")
        return Segment(*(x[order] for x in cols))


def _memtables(memtable_bytes: int, width: int, buckets: int, largest: bool):
    def flush(run: int, table: dict):
        entries = sorted((hashlib.sha256(text).digest(), i, scores) for i, (text, scores) in enumerate(table.items()))
        bucket = [int.from_bytes((d[:width] + b"\0\0\0\0")[:4], "big") * buckets >> 32 for d, _, _ in entries]
        cols = {
            "run": [run] * len(entries), "bucket": bucket, "digest": [d for d, _, _ in entries], "best": [max(s) for _, _, s in entries],
            "n": [len(s) for _, _, s in entries], "ids": [s for _, _, s in entries], "segment": [None] * len(entries), "filter": [None] * len(entries),
        }
        at = 0
        while at < len(entries):
            to = at
            while to < len(entries) and bucket[to] == bucket[at]:
                to += 1
            keys = np.array([d[:width] for d in cols["digest"][at:to]], f"S{width}")
            keys, first = np.unique(keys, return_index=True)
            best = np.maximum.reduceat(np.array(cols["best"][at:to], np.int64), first)
            n = np.add.reduceat(np.array(cols["n"][at:to], np.int64), first)
            many = np.diff(np.append(first, to - at))
            for k, v in (("run", run), ("bucket", bucket[at]), ("digest", None), ("best", None), ("n", len(keys)), ("ids", None)):
                cols[k].append(v)
            cols["segment"].append(keys.tobytes() + np.stack([best, n, many]).astype("<i8").tobytes())
            cols["filter"].append(Bloom.of(keys).bits.tobytes())
            at = to
        kinds = {"run": pa.int64(), "bucket": pa.int32(), "digest": pa.binary(), "best": pa.int64(), "n": pa.int64(), "ids": pa.list_(pa.int64()), "segment": pa.binary(), "filter": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in kinds.items()], names=list(kinds))

    def run(it):
        part, seq, table, size = TaskContext.get().partitionId(), 0, {}, 0
        for b in units(it, "text", memtable_bytes):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                score = NONE if i is None else i if largest else ~i
                if text in table:
                    table[text].append(score)
                    size += 40
                else:
                    table[text] = [score]
                    size += len(text) + 200
                if size >= memtable_bytes:
                    yield flush(part << 32 | seq, table)
                    seq, table, size = seq + 1, {}, 0
        if table:
            yield flush(part << 32 | seq, table)

    return run


def _compact(width: int):
    """Merges the segments of each bucket, the smallest first, and gives the digests of several entries."""

    def merged(parts: list):
        heap = []
        for i, (run, n, segment, bits) in enumerate(parts):
            keys = np.frombuffer(segment, f"S{width}", n)
            best, rows, many = np.frombuffer(segment, "<i8", 3 * n, n * width).reshape(3, n).copy()
            heap.append((n, i, Segment(keys, best, np.full(n, run), rows, many, Bloom(np.frombuffer(bits, np.uint8)))))
        heapq.heapify(heap)
        number = itertools.count(len(heap))
        while len(heap) > 1:
            small, large = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
            both = large.merge(small)
            heapq.heappush(heap, (len(both), next(number), both))
        x = heap[0][2]
        hit = np.flatnonzero(x.entries > 1)
        keys = [x.digests[i].ljust(width, b"\0") for i in hit]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(x.best[hit]), pa.array(x.run[hit]), pa.array(x.n[hit])], ["key", "keep", "keep_run", "size"])

    def run(it):
        bucket, parts = None, []
        for b in it:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "run", "n", "segment", "filter"))):
                if k != bucket and parts:
                    yield merged(parts)
                    parts = []
                bucket = k
                parts.append(row)
        if parts:
            yield merged(parts)

    return run


def exact_groups(docs: DataFrame, largest: bool = False, memtable_bytes: int = 16 << 20, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Of equal texts the row with the smallest doc_id stays, or the largest on request. `digest_bytes`
    shortens the index's keys (the byte check then has work to do).
    """
    spark = docs.sparkSession
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    buckets = max(16, base.select("doc_id").count() // 200_000)
    runs = materialise(base.mapInArrow(_memtables(memtable_bytes, digest_bytes, buckets, largest), RUNS), "runs")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, 4096))
    hits = (
        runs.filter("segment is not null").select("bucket", "run", "n", "segment", "filter")
        .repartition(n, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_compact(digest_bytes), "key binary, keep long, keep_run long, size long")
    )
    hits = materialise(hits, "hits")
    members = runs.filter("segment is null").select("run", "digest", "best", "n", "ids", F.substring("digest", 1, digest_bytes).alias("key"))
    # byte check: the texts of the representatives of all entries of a hit must agree
    score = F.when(F.col("doc_id").isNull(), F.lit(NONE)).otherwise(F.col("doc_id") if largest else F.bitwise_not("doc_id"))
    reps = members.join(hits.select("key"), "key", "left_semi").select("key", "digest", "best").distinct()
    texts = base.select(score.alias("best"), F.unhex(F.sha2("text", 256)).alias("digest"), "text").join(reps, ["best", "digest"])
    bad = materialise(texts.groupBy("key").agg((F.min("text") == F.max("text")).alias("same")).filter("not same").select("key"), "bad")
    group = members.join(hits, "key", "left")
    found = (F.coalesce("keep", "best").alias("keep"), F.coalesce("keep_run", "run").alias("keep_run"), F.coalesce("size", "n").alias("size"))
    if bad.limit(1).count():
        wrong = members.join(bad, "key", "left_semi")
        again = wrong.groupBy("digest").agg(F.max(F.struct("best", (-F.col("run")).alias("r"))).alias("m"), F.sum("n").alias("size"))
        again = again.select("digest", F.col("m.best").alias("keep"), (-F.col("m.r")).alias("keep_run"), "size")
        group = members.join(bad, "key", "left_anti").join(hits, "key", "left").select("run", "digest", "ids", *found).unionByName(
            wrong.join(again, "digest").select("run", "digest", "ids", "keep", "keep_run", "size"))
    else:
        group = group.select("run", "digest", "ids", *found)
    # the first of the member rows that bear the staying id, in the run that has it
    first = F.when(F.col("run") == F.col("keep_run"), F.array_position("ids", F.col("keep")) - 1).otherwise(F.lit(-1))
    rows = group.select("digest", "keep", "size", first.alias("first"), F.posexplode("ids").alias("at", "score"))
    back = lambda c: F.when(F.col(c) != NONE, F.col(c) if largest else F.bitwise_not(c))
    return rows.select(
        back("score").alias("doc_id"), back("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("at") == F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, largest: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names."""
    kept = exact_groups(docs, largest).filter("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.unhex(F.sha2(text_bytes(), 256)).alias("own_sha"), whole_row(docs).alias("row"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rows = rows.withColumn("bytes", text_bytes("row.text")).dropDuplicates(["own_id", "bytes"])
    return rows.select("row.*")
