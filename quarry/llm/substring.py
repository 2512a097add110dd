"""Substring dedup by super-k-mer partitioning.

A window is `k` consecutive words of one document. Every window has a minimiser: the smallest hash
among its m-word grams. Consecutive windows with one minimiser form a super-k-mer; it travels as one
packed string to the bucket of its minimiser, and equal windows meet there. Sorting a bucket's
windows by hash finds, for every distinct word sequence, the smallest doc_id in which it starts; windows
of documents with larger ids are repeats, and each word that such a window covers is removed. Hashes only
bring equals together: the words of windows (and of super-k-mers) of one hash are compared byte for
byte, and where they differ a bucket numbers its words and sorts by these numbers instead.

Skew: equal super-k-mers of one unit of input (8 MB) are collapsed before the shuffle; only the one
of the smallest id travels, the others are known repeats already. Minimisers that hold 1/(4 * parts) of all super-k-mers (with
64 to 4096 for parts) are dealt window by window, by the hash of the whole window; the census finds
all of these, and may add such as hold half of that, 32768 at most altogether.

Defined cases: null or empty text has no words; a null doc_id counts as larger than all others and
equal to no smaller one; rows that share a doc_id never make each other's words repeats; a very long
text is a unit of its own, and its super-k-mers are dealt like others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MAX_ID, batched, gathered, grams, join_texts, mix, powers, rid, text_bytes, window_min, words_of

UNIT = 8 << 20  # bytes of text that are handled at a time
PART = 8 << 20  # bytes of text per bucket partition: what is sorted at a time
TASKS = 1 << 16  # at most so many tasks share the bucket partitions


LONG = 64  # bytes; longer words are compared one by one
HELD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the bytes of a word that are left of eight


def same_words(buf: bytes, s: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the words buf[s:e] of numbers i and j are equal, byte for byte."""
    raw = buf + bytes(8)
    eight = np.ndarray(len(buf) + 1, "<u8", raw, 0, (1,))  # the eight bytes from every place on
    out = np.empty(len(i), bool)
    for lo in range(0, len(i), 1 << 18):
        a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
        sa, sb, n = s[a], s[b], e[a] - s[a]
        ok = n == e[b] - sb
        at = np.flatnonzero(ok)
        for c in range(0, LONG, 8):
            at = at[n[at] > c]
            if not len(at):
                break
            ok[at] &= ((eight[sa[at] + c] ^ eight[sb[at] + c]) & HELD[np.minimum(n[at] - c, 8)]) == 0
        for x in at[n[at] > LONG].tolist():
            ok[x] = buf[sa[x] : sa[x] + n[x]] == buf[sb[x] : sb[x] + n[x]]
        out[lo : lo + (1 << 18)] = ok
    return out


def _runs(column, k: int, m: int, hot: np.ndarray):
    """The super-k-mers of a column of texts, as arrays; None if there is none."""
    buf, at = join_texts(column.to_pylist())
    s, e, h = words_of(buf)
    s, e = s.astype(np.int32), e.astype(np.int32)  # a column of Arrow has less than 2^31 bytes
    doc = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(np.searchsorted(s, at), len(s))))
    n = len(h) - k + 1
    if n <= 0:
        return None
    whole = doc[:n] == doc[k - 1 :]
    low = window_min(grams(h, m, 11), k - m + 1)
    spread = np.isin(low, hot) if len(hot) else np.zeros(n, bool)
    first = np.ones(n, bool)
    first[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1]) | spread[1:] | spread[:-1]
    first &= whole
    i0 = np.flatnonzero(first)
    if not len(i0):
        return None
    # a run ends before the next one, or where windows stop being whole
    stop = np.searchsorted(np.flatnonzero(~whole), i0)
    bad = np.append(np.flatnonzero(~whole), n)
    i1 = np.minimum(np.append(i0[1:], n), bad[stop])  # one past the last window
    p, inv = powers(len(h))
    del whole, bad, stop, first
    sums = np.zeros(len(h) + 1, np.uint64)
    h = mix(h)
    h *= p[: len(h)]
    np.cumsum(h, out=sums[1:])
    last = i1 + k - 1  # one past the last word
    key = mix((sums[last] - sums[i0]) * inv[i0] + (last - i0).astype(np.uint64))
    base = np.searchsorted(doc, np.arange(len(at), dtype=np.int32))  # first word of each text
    return {
        "buf": buf, "s": s[i0], "e": e[last - 1], "doc": doc[i0], "start": i0 - base[doc[i0]], "words": last - i0,
        "key": key, "low": low[i0], "bucket": np.where(spread[i0], key, mix(low[i0])), "first": i0, "from": s, "to": e,
    }


def _by_unit(unit):
    """What `unit` makes of each unit of text; nothing of one unit is held while the next is gathered."""

    def run(it):
        for b in gathered(it, "text", UNIT):
            out = unit(b)
            del b
            if out is not None:
                yield out
            del out

    return run


def _census(k: int, m: int, keep: int):
    """Per unit: how many super-k-mers, and the minimisers that hold at least 1/keep of them."""

    def unit(b):
        r = _runs(b.column("text"), k, m, np.empty(0, np.uint64))
        low, c = np.unique(r["low"], return_counts=True) if r else (np.empty(0, np.uint64), np.empty(0, np.int64))
        big = c * keep >= c.sum()
        return pa.RecordBatch.from_arrays([pa.array([None, *low[big].view(np.int64)], pa.int64()), pa.array([int(c.sum()), *c[big]], pa.int64())], ["low", "n"])

    return _by_unit(unit)


HEAD = "<II"  # known repeats, super-k-mers


def _collapsed(r: dict, ids: np.ndarray) -> np.ndarray:
    """Which super-k-mers of a unit travel: of equal ones those of the smallest id; all of those that only share a hash."""
    order = np.lexsort((ids, r["key"]))
    key, oid = r["key"][order], ids[order]
    new = np.append(True, key[1:] != key[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    drop = np.flatnonzero(oid != oid[head])
    goes = np.ones(len(order), bool)
    if not len(drop):
        return goes
    x, y = order[drop], order[head[drop]]
    n = r["words"][x]
    equal = n == r["words"][y]
    x, y, n = x[equal], y[equal], n[equal]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    same = same_words(r["buf"], r["from"], r["to"], np.repeat(r["first"][x], n) + step, np.repeat(r["first"][y], n) + step)
    goes[x[np.logical_and.reduceat(same, np.cumsum(n) - n)] if len(x) else x] = False
    return goes


def _pack(parts: int, tasks: int, k: int, m: int, hot: np.ndarray):
    def unit(b):
        z = zstandard.ZstdCompressor(level=3)
        r = _runs(b.column("text"), k, m, hot)
        if r is None:
            return None
        ids = np.asarray(b.column("rid"), dtype=np.int64)[r["doc"]]
        tags = np.asarray(b.column("tag"), dtype=np.int64)[r["doc"]]
        goes = _collapsed(r, ids)  # what stays behind is a repeat
        part = (r["bucket"] % np.uint64(parts)).astype(np.int64)
        part = np.where(goes, part, (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64))
        by = np.lexsort((r["start"], ids, goes, part))
        cuts = np.flatnonzero(np.append(True, part[by][1:] != part[by][:-1]))
        buf, s, e = r["buf"], r["s"], r["e"]
        out_part, out_blob = [], []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(by))):
            x = by[lo:hi]
            g = x[goes[x]]
            meta = np.stack([ids[x], tags[x], r["start"][x], r["words"][x]])
            text = b"\n".join([buf[i:j] for i, j in zip(s[g].tolist(), e[g].tolist())])
            out_part.append(int(part[x[0]]))
            out_blob.append(z.compress(struct.pack(HEAD, len(x) - len(g), len(g)) + meta.astype("<i8").tobytes() + text))
        return pa.RecordBatch.from_arrays([pa.array([p % tasks for p in out_part], pa.int32()), pa.array(out_part, pa.int32()), pa.array(out_blob, pa.binary())], ["task", "part", "blob"])

    return _by_unit(unit)


def _ranges(ids, tags, start, words):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array((start.astype(np.int64) << 32) | words.astype(np.int64), pa.int64())],
        ["rid", "tag", "span"],
    )


def _repeats(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the ordered values equal the one before."""
    x = x[order]
    return x[1:] == x[:-1]


def _differ(buf: bytes, s: np.ndarray, e: np.ndarray, first: np.ndarray, order: np.ndarray, same: np.ndarray, k: int) -> bool:
    """Whether any window has other words than the one before it that has its hash; first is each window's first word."""
    before = np.full(len(order), -1, np.int32)
    before[order[1:][same]] = order[:-1][same]
    x = np.flatnonzero(before >= 0)
    if not len(x):
        return False
    a, b = first[x], first[before[x]]
    on = np.append(False, (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1))  # the next windows of both: only their last words are new
    if not same_words(buf, s, e, a + (k - 1), b + (k - 1)).all():
        return True
    a, b = a[~on], b[~on]
    return not all(same_words(buf, s, e, a + j, b + j).all() for j in range(k - 1))


def _by_words(buf: bytes, s: np.ndarray, e: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by the words themselves, and which equal the one before: for hashes that collide."""
    number: dict = {}
    words = np.array([number.setdefault(buf[i:j], len(number)) for i, j in zip(s.tolist(), e.tolist())], np.int32)
    order, same = np.lexsort([words[first + j] for j in range(k)]), np.ones(len(first) - 1, bool)
    for j in range(k):
        same &= _repeats(words[first + j], order)
    return order, same


def _count(k: int):
    """Sorts the windows of one bucket partition and gives the word ranges that are repeats."""

    def bucket(blobs):
        z = zstandard.ZstdDecompressor()
        # a window is a hash and, in 32 bits each, its super-k-mer, its place in the document and its first word here
        hs, which, pos, words, ids, tags, base, texts, ss, es, at, seen = [], [], [], [], [], [], 0, [], [], [], 0, 0
        for blob in blobs:
            raw = z.decompress(blob)
            known, n = struct.unpack_from(HEAD, raw)
            meta = np.frombuffer(raw, "<i8", 4 * (known + n), 8).reshape(4, -1)
            if known:
                yield _ranges(meta[0, :known], meta[1, :known], meta[2, :known], meta[3, :known])
            if not n:
                continue
            meta = meta[:, known:].copy()
            texts.append(raw[8 + 32 * (known + n) :] + b"\n")
            del raw
            s, e, h = words_of(texts[-1])
            unit = np.repeat(np.arange(n, dtype=np.int32), meta[3])
            first = np.cumsum(meta[3]) - meta[3]
            w = np.flatnonzero(unit[: len(h) - k + 1] == unit[k - 1 :])
            u = unit[w]
            hs.append(grams(h, k, 12)[w])
            which.append(u + np.int32(base))
            pos.append((meta[2][u] + w - first[u]).astype(np.int32))
            words.append((w + seen).astype(np.int32))
            seen += len(s)
            ss.append((s + at).astype(np.int32))
            es.append((e + at).astype(np.int32))
            at += len(texts[-1])
            ids.append(meta[0])
            tags.append(meta[1])
            base += n
        if not hs:
            return
        h = np.concatenate(hs)
        del hs
        text = b"".join(texts)
        del texts
        which, place, words, ids, tags, s, e = (np.concatenate(x) for x in (which, pos, words, ids, tags, ss, es))
        del pos, ss, es
        order = np.argsort(h, kind="stable")
        same = _repeats(h, order)
        del h
        if _differ(text, s, e, words, order, same, k):
            order, same = _by_words(text, s, e, words, k)
        head = np.flatnonzero(np.append(True, ~same))
        del same, words, s, e, text
        oid = ids[which[order]]
        least = np.repeat(np.minimum.reduceat(oid, head), np.diff(np.append(head, len(oid))))
        x = order[oid > least]
        if not len(x):
            return
        i, t, a = ids[which[x]], tags[which[x]], place[x]
        by = np.lexsort((a, t, i))
        i, t, a = i[by], t[by], a[by]
        new = np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1] + 1))
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(x))) + k - 1
        yield _ranges(i[head], t[head], a[head], length)

    def run(it):
        part, blobs = None, []
        for b in it:
            for p, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
                if p != part and blobs:
                    yield from bucket(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from bucket(blobs)

    return run


def _cut(it):
    for b in it:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            w = text.split()
            gone = 0
            if spans:
                edge = np.zeros(len(w) + 1, np.int32)
                x = np.array(spans, np.int64)
                np.add.at(edge, x >> 32, 1)
                np.add.at(edge, (x >> 32) + (x & 0xFFFFFFFF), -1)
                stay = np.cumsum(edge[:-1]) == 0
                gone = len(w) - int(stay.sum())
                kept.append(b" ".join([w[i] for i in np.flatnonzero(stay)]))
            else:
                kept.append(b" ".join(w))
            n_words.append(len(w))
            n_removed.append(gone)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(docs: DataFrame, k: int = 13, m: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), rid().alias("rid"), text_bytes().alias("text"))
    twice = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    base = base.withColumn("tag", F.xxhash64("text") if twice else F.lit(0).cast("long"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART))
    # a unit leaves out counts below 1/keep of its own, together 1/keep of all at most: what holds 2/keep is never missed
    keep = 8 * min(max(parts, 64), 4096)
    census = base.select("text").mapInArrow(_census(k, m, keep), "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
    total = census.filter("low is null").first()
    least = max(2, -(-(int(total["n"]) if total else 0) // keep))
    # the counts sum to n at most, so no more than keep, 32768, minimisers can reach the threshold
    hot = np.array(sorted(x["low"] for x in census.filter(F.col("low").isNotNull() & (F.col("n") >= least)).collect()), np.int64).view(np.uint64)
    n = max(min(parts, TASKS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = base.select("rid", "tag", "text").mapInArrow(_pack(parts, n, k, m, hot), "task int, part int, blob binary")
    spans = packed.repartitionById(n, F.col("task")).sortWithinPartitions("part").drop("task").mapInArrow(_count(k), "rid long, tag long, span long")
    spans = spans.groupBy("rid", "tag").agg(F.collect_list("span").alias("spans"))
    both = base.join(spans, ["rid", "tag"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def brute_force(rows: list[tuple], k: int = 13) -> list[tuple]:
    """The same result, plainly: for tests."""
    words = [((MAX_ID if i is None else i), (t or "").encode().split()) for i, t in rows]
    least: dict = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            least[g] = min(i, least.get(g, i))
    out = []
    for (i, w), (doc_id, _) in zip(words, rows):
        gone = {a + j for a in range(len(w) - k + 1) if least[tuple(w[a : a + k])] < i for j in range(k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
