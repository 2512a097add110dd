"""Shared helpers of the training-data operators: scratch tables in the shared folder and
vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = (1 << 63) - 1  # stands for a null doc_id, so that nulls sort after every id


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset a folder of our own, in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = _own_dir()
    return where.rstrip("/")


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quarry-scratch-"))
        atexit.register(_remove_own)
    return _OWN[0]


def _remove_own() -> None:
    import shutil

    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


_SCOPE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([scratch_dir(spark), f"quarry-{spark.sparkContext.applicationId}", *_SCOPE, f"{name}-{uuid.uuid4().hex[:12]}"])


def materialise(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage, survives lost executors.

    The table's path is added to `paths`, for `drop_scratch` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders through Hadoop's file system, wherever they lie; the list is empty after that."""
    jvm = spark.sparkContext._jvm
    while paths:
        p = jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession, name: str):
    """What scratch tables are made inside lie in one folder, deleted at the end: results must have been written elsewhere by then."""
    path = scratch_path(spark, name)
    _SCOPE.append(path.rsplit("/", 1)[1])
    try:
        yield
    finally:
        _SCOPE.pop()
        drop_scratch(spark, [path])


def whole_row(df: DataFrame):
    """All columns of df as one struct: helper columns beside it cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def batched(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded to 512 rows and 8 MB: at the default of 10,000 rows a batch of long
    texts is far beyond what a worker, and the JVM's direct memory, should hold at once. The setting stays (it is only
    ever lowered), as plans that are returned from here run later."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 512), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def rid(col: str = "doc_id"):
    """The id used for order: a null id counts as larger than all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(MAX_ID))


def text_bytes(col: str = "text"):
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def batches(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def units(it, text: str, limit: int):
    """Cuts record batches into slices of about `limit` text bytes: bounded memory whatever the row sizes.

    A slice never holds a null text (callers coalesce) and a single longer text is a slice of its own.
    """
    for batch in it:
        n, at = batch.num_rows, 0
        if not n:
            continue
        lens = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(lens)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(it, text: str, limit: int):
    """Like `units`, with consecutive small slices put together, so that a slice's size does not hang on the batches'."""
    held, size = [], 0
    for u in units(it, text, limit):
        n = (pc.sum(pc.binary_length(u.column(text))).as_py() or 0) + 16 * u.num_rows
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(u)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- word hashing -----------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(int(BASE), -1, 1 << 64))
PIECE = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    if "p" not in _powers or len(_powers["p"]) < n + 1:
        size = max(n + 1, PIECE + 1)
        for key, base in (("p", BASE), ("i", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; wraps on purpose."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _piece(a: np.ndarray, at: int):
    sp = SPACE[a]
    edge = np.empty(len(a) + 1, bool)
    edge[0] = not sp[0]
    edge[-1] = not sp[-1]
    np.not_equal(sp[1:], sp[:-1], out=edge[1:-1])
    cut = np.flatnonzero(edge)
    s, e = cut[0::2], cut[1::2]
    p, inv = powers(len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[a] * p[: len(a)], out=sums[1:])
    return s + at, e + at, mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64))


def words_of(buf, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of non-space bytes. Spaces are 0x20 and 0x09-0x0D."""
    a = np.frombuffer(buf, np.uint8)
    if lower:
        a = LOWER[a]
    out, at, n = [], 0, len(a)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            sp = np.flatnonzero(SPACE[a[at:to]])
            if len(sp):
                to = at + int(sp[-1]) + 1
            else:  # one giant word: take all of it
                while to < n and not SPACE[a[to]]:
                    nxt = np.flatnonzero(SPACE[a[to : to + PIECE]])
                    to = to + int(nxt[0]) if len(nxt) else min(n, to + PIECE)
        out.append(_piece(a[at:to], at))
        at = to
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def join_texts(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts joined by a newline, and the offset at which each starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return b"\n".join(texts), np.cumsum(lens) - lens


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    c = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, k, dtype=np.uint64) * _U(2) + _U(1)
    for j in range(k):
        out += mix(h[j : j + n] ^ c[j]) * c[j] if seed & 1 else h[j : j + n] * c[j]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n]) if w > span else x[:n]
