"""Document fingerprints by winnowing.

Every run of k code points has a 40-bit rolling hash (prefix sums of a polynomial); of every window of
w consecutive hashes the smallest is selected, the rightmost of equal ones, and kept with its
position. Two texts that share a run of w + k - 1 code points share a selected hash. A text with
fewer than k code points has one hash, of all of it; the empty text has none. Likeness is the share of
common hashes among all distinct ones of both (two empty fingerprints: 1).

The comparison with edited texts needs each document's successor by id: rows are dealt and sorted by
ranges of the id, each text moving once, and the last document of each range waits for the first of
the next, as few rows as there are ranges.

Defined cases: null text is empty; a null doc_id comes after all others; rows that share an id follow
each other by their first 256 code points, then by SHA-256 of the text, and ranges may cut between any
two of them; a single row is its own successor; very long texts are hashed in pieces of 262,144 windows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batched, materialise, mix, powers, rid, window_min

K, WINDOW = 16, 32
PIECE = 1 << 18  # hashes handled at a time
POSITION = (1 << 24) - 1


def fingerprint(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions in code points, ascending."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(x)
    if n < k:
        p, _ = powers(n)
        h = mix((mix(x + np.uint64(1)) * p[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) >> np.uint64(24)
        return (h[:n].astype(np.int64), np.zeros(min(n, 1), np.int64))
    hashes, places, m = [], [], n - k + 1
    for lo in range(0, max(m - w + 1, 1), PIECE):
        hi = min(m, lo + PIECE + w - 1)  # the windows that start in [lo, lo + PIECE)
        y = x[lo : hi + k - 1]
        p, inv = powers(len(y))
        sums = np.zeros(len(y) + 1, np.uint64)
        np.cumsum(mix(y + np.uint64(1)) * p[: len(y)], out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * inv[: hi - lo]) >> np.uint64(24)
        # the smallest key of a window is its smallest hash, and the rightmost of equal ones
        key = (h << np.uint64(24)) | (np.uint64(POSITION) - np.arange(hi - lo, dtype=np.uint64))
        low = window_min(key, min(w, hi - lo))
        low = low[np.append(True, low[1:] != low[:-1])]
        places.append(lo + POSITION - (low & np.uint64(POSITION)).astype(np.int64))
        hashes.append((low >> np.uint64(24)).astype(np.int64))
    h, at = np.concatenate(hashes), np.concatenate(places)
    if len(hashes) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return h, at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two arrays of hashes, as sets."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def name_of(h: np.ndarray, at: np.ndarray) -> str:
    """One string for a fingerprint: the SHA-256 of its hashes and positions."""
    return hashlib.sha256(np.stack([h, at]).astype("<i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes, positions of every row of docs (doc_id, text)."""

    def run(it):
        for b in it:
            out = [fingerprint(t or "", k, w) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[i].tolist() for x in out], pa.list_(pa.int64())) for i in (0, 1))], ["doc_id", "hashes", "positions"])

    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


ROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
DDL = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id, text: str, own, following: str, nxt, k: int, w: int) -> dict:
    changed = edit(text, following)
    e = fingerprint(changed, k, w)
    return {
        "kind": 0, "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": name_of(*own),
        "edited_fingerprint": name_of(*e), "near_edited": likeness(own[0], e[0]), "near_next": likeness(own[0], nxt[0]),
    }


def _stream(k: int, w: int):
    """Compares each document of a sorted range with the next; the ends of the range go out with their texts."""

    def run(it):
        part, last = TaskContext.get().partitionId(), None
        for b in it:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = fingerprint(text, k, w)
                if last is None:
                    rows.append({"kind": 1, "part": part, "doc_id": doc_id, "text": text})
                else:
                    rows.append(_compared(*last, text, own, k, w))
                last = (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(rows, ROW)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"kind": 2, "part": part, "doc_id": last[0], "text": last[1]}], ROW)

    return run


def compare_with_next(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), rid().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["rid"]
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # many rows of one id (or with none) are spread over ranges too; equal ones by where they stand in the input
        base = base.withColumn("head", F.substring("text", 1, 256)).withColumn("sha", F.sha2(F.col("text"), 256)).withColumn("nth", F.monotonically_increasing_id())
        keys += ["head", "sha", "nth"]
    sorted_rows = base.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows = materialise(sorted_rows.mapInArrow(_stream(k, w), DDL), "compared")
    parts = sorted(x[0] for x in rows.filter("kind = 1").select("part").collect())  # one number per range
    if not parts:
        return rows.drop("kind", "part", "text")
    order = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1])], "part int, next int")
    heads = rows.filter("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = rows.filter("kind = 2").select("part", "doc_id", "text").join(order, "part").join(heads, "next").select("doc_id", "text", "following")

    def close(it):
        for b in it:
            out = [_compared(i, t, fingerprint(t, k, w), f, fingerprint(f, k, w), k, w) for i, t, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")))]
            yield pa.RecordBatch.from_pylist(out, ROW)

    return rows.filter("kind = 0").unionByName(ends.mapInArrow(close, DDL)).drop("kind", "part", "text")
