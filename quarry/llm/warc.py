"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: of pages with equal payloads the one with the smallest page_id becomes a response record, the
others revisit records that name it and carry no payload. Records are written by Spark's own text
writer, so archives may lie in any store Spark can write.

Reading: splits of the archives are cut at every "WARC/1."; each piece is a candidate record with the
offset of its successor, computed from its own header. Within a split candidates are followed to where
their chain leaves the split; pointer jumping over these exits, from offset 0 of each file, finds the
one reachable entry of every split, and a walk from there keeps reachable records only. Magic inside
payloads is on no chain from the file's start and is rejected, whatever headers it brings along.
Payloads that contain magic, or run over a split's end, are put together from their pieces in a second
reading of just those pieces.

Defined cases: null html is an empty payload; a null page_id counts as larger than all others and is
written as an empty field; rows that repeat the smallest page_id are all response; payloads under
`least` bytes are never revisited; line breaks in url or page_id are dropped from headers; a very long
payload may run over many splits; an empty table gives an empty result; other columns are ignored.
Archives compressed by gzip, member after member, are read where their names end in .gz, each by one task.
"""

from __future__ import annotations

import base64
import hashlib
import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import MAX_ID, batched, drop_scratch, materialise, rid, scratch_path, units

MAGIC = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_of(payload: bytes) -> str:
    """The bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pack(it):
    """Payloads with their digest, compressed for the way to their record's place."""
    z = zstandard.ZstdCompressor(level=9)
    for b in units(it, "html", 8 << 20):
        html = b.column("html").to_pylist()
        extra = [pa.array([sha1_of(x) for x in html]), pa.array([z.compress(x) for x in html], pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.drop_columns(["html"]).columns, *extra], [*(n for n in b.schema.names if n != "html"), "sha1", "packed"])


def record(page_id, url: str, sha1: str, payload: bytes, to=None) -> bytes:
    """A record without the two line ends that close it; a revisit of page `to` where that is given."""
    name = lambda i: b"<urn:page:%s>" % (b"" if i in (None, MAX_ID) else str(i).encode())
    kind = b"response" if to is None else b"revisit"
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name(page_id), b"WARC-Target-URI: " + url.encode().replace(b"\r", b"").replace(b"\n", b""), b"WARC-Payload-Digest: sha1:" + sha1.encode()]
    if to is not None:
        payload = b""
        lines += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + name(to)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(payload), b"", payload])


def _render(it):
    z = zstandard.ZstdDecompressor()
    for b in units(it, "packed", 1 << 20):
        out = [record(i, u, s, z.decompress(p) if t is None else b"", t) for i, u, s, p, t in zip(*(b.column(c).to_pylist() for c in ("rid", "url", "sha1", "packed", "to")))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes a record per row of pages (page_id, url, html)."""
    base = batched(pages).select(F.col("page_id").cast("long").alias("page_id"), rid("page_id").alias("rid"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    key = base.select("rid", F.unhex(F.sha2("html", 256)).alias("sha"), F.octet_length("html").cast("long").alias("bytes"))
    first = key.groupBy("sha", "bytes").agg(F.min("rid").alias("to"), F.max("rid").alias("top")).filter((F.col("to") < F.col("top")) & (F.col("bytes") >= least))
    # one row per page id and payload that revisits; pages are joined by both, as ids may repeat
    again = key.join(first, ["sha", "bytes"]).filter("rid > to").select("rid", "sha", "to").distinct()
    twice = _repeats(base)
    sent = base.select("rid", "url", F.unhex(F.sha2("html", 256)).alias("sha") if twice else F.lit(b"").alias("sha"), F.col("html").cast("binary").alias("html")).mapInArrow(_pack, "rid long, url string, sha binary, sha1 string, packed binary")
    rows = sent.join(again, ["rid", "sha"], "left") if twice else sent.drop("sha").join(again.drop("sha"), "rid", "left")
    rows.select("rid", "url", "sha1", "packed", "to").mapInArrow(_render, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 100_000).text(path)


def _repeats(base: DataFrame) -> bool:
    return base.groupBy("rid").count().filter("count > 1").limit(1).count() > 0


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def header(piece: bytes):
    """(bytes of the header with its blank line, fields) of what follows the magic, or None."""
    if piece[:3] not in (b"1\r\n", b"0\r\n"):
        return None
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return (end + 4, fields) if fields.get("content-length", "").isdigit() else None


CANDIDATE = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("size", pa.int64()), ("kind", pa.string()),
    ("id", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()),
])


def _candidates(it):
    """Candidates of each split, relative to its first byte; size is that of the piece with its magic."""

    def out(rows):
        at = {r["rel"]: i for i, r in enumerate(rows)}
        for r in reversed(rows):  # follow each chain to where it leaves the split
            to = at.get(r["next"]) if r["next"] is not None else None
            r["exit"] = rows[to]["exit"] if to is not None else r["next"]
        return pa.RecordBatch.from_pylist(rows, CANDIDATE)

    now, rows, rel = None, [], 0
    for b in it:
        for file, block, value in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value")):
            if (file, block) != now:
                if rows:
                    yield out(rows)
                now, rows, rel = (file, block), [], 0
                rel = 0 if block == 0 else -len(MAGIC)
                first = block == 0
            else:
                first = False
            value = value.as_buffer().to_pybytes()
            row = dict.fromkeys(CANDIDATE.names)
            # the first piece of a file follows no magic; what a split reads first follows that of the split before
            row |= {"file": file, "block": block, "rel": rel, "size": len(value) + (0 if first else len(MAGIC))}
            if not first and (h := header(value)):
                n, fields = h
                length = int(fields["content-length"])
                row |= {"next": rel + len(MAGIC) + n + length + 4, "kind": fields.get("warc-type"), "id": fields.get("warc-record-id"), "digest": fields.get("warc-payload-digest"), "refers": fields.get("warc-refers-to")}
                if len(value) == n + length + 4 and value[-4:] == b"\r\n\r\n":
                    payload = value[n:-4]
                    row |= {"bytes": len(payload), "sha1": sha1_of(payload)}
            rows.append(row)
            rel += row["size"]
    if rows:
        yield out(rows)


def _walk(it):
    """Marks the candidates of each split that are on the chain from its entry."""
    now, at = None, None
    for b in it:
        keep = []
        for file, block, offset, nxt, entry in zip(*(b.column(c).to_pylist() for c in ("file", "block", "offset", "next", "entry"))):
            if (file, block) != now:
                now, at = (file, block), entry
            on = at is not None and offset == at and nxt is not None
            at = nxt if on else at
            keep.append(on)
        yield b.drop_columns(["entry"]).append_column("on", pa.array(keep, pa.bool_()))


def _reachable(cand: DataFrame, paths: list[str]) -> DataFrame:
    """The candidates (file, offset, next, exit, ...) with `on`: whether a chain from the file's start leads there."""
    spark = cand.sparkSession
    jump = cand.filter("next is not null").select("file", "offset", F.col("exit").alias("to"))
    reach = cand.filter("offset = 0").select("file", "offset").distinct()
    blocks = cand.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(blocks)) if blocks > 1 else 0):
        reach = materialise(reach.union(reach.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct(), "reach", paths)
        after = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("to2"))
        jump = materialise(jump.join(after, ["file", "to"]).select("file", "offset", F.col("to2").alias("to")), "jump", paths)
    entries = cand.join(reach, ["file", "offset"], "left_semi").groupBy("file", "block").agg(F.min("offset").alias("entry"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cand.join(entries, ["file", "block"], "left").repartition(n, "file", "block").sortWithinPartitions("file", "block", "offset")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cand.schema)
    return rows.select(*cand.columns, "entry").mapInArrow(_walk, f"{fields}, `on` boolean")


def _joined(pdf):
    """Puts the pieces of one record together."""
    import pandas as pd

    pdf = pdf.sort_values("offset")
    raw = MAGIC.join(bytes(x) for x in pdf["value"])
    n, fields = header(raw)
    length = int(fields["content-length"])
    payload = raw[n : n + length] if raw[n + length : n + length + 4] == b"\r\n\r\n" else None
    size, sha1 = (len(payload), sha1_of(payload)) if payload is not None else (None, None)
    return pd.DataFrame({"file": [pdf["file"].iloc[0]], "offset": [int(pdf["record"].iloc[0])], "bytes2": pd.array([size], "Int64"), "sha2": [sha1]})


def read(spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
    """file, offset, kind, id, digest (as its header has it), refers, bytes and sha1 (of the payload as read; null if torn) of every record on a chain.

    The scratch tables under the result are added to paths.
    """
    paths, early = [] if paths is None else paths, []
    raw = _pieces(spark, path).mapInArrow(_candidates, "file string, block long, rel long, next long, exit long, size long, kind string, id string, digest string, refers string, bytes long, sha1 string")
    raw = materialise(raw, "candidates", early)
    base = raw.groupBy("file", "block").agg(F.sum("size").alias("s"))
    base = base.withColumn("base", F.sum("s").over(W.partitionBy("file").orderBy("block")) - F.col("s")).select("file", "block", "base")
    shift = F.col("base") + F.when(F.col("block") == 0, 0).otherwise(len(MAGIC))  # a later split's rel starts before its first byte
    cand = raw.join(base, ["file", "block"]).withColumn("offset", F.col("rel") + shift)
    cand = cand.select("file", "block", "rel", "offset", (F.col("next") + shift).alias("next"), (F.col("exit") + shift).alias("exit"), "kind", "id", "digest", "refers", "bytes", "sha1")
    cand = materialise(_reachable(materialise(cand, "offsets", early), early), "chains", paths)
    drop_scratch(spark, early)
    records = cand.filter("`on`").select("file", "offset", "kind", "id", "digest", "refers", "bytes", "sha1")
    if not records.filter("sha1 is null").limit(1).count():
        return records
    own = F.last(F.when(F.col("on"), F.col("offset")), True).over(W.partitionBy("file").orderBy("offset"))
    torn = records.filter("sha1 is null").select("file", F.col("offset").alias("record"))
    want = cand.withColumn("record", own).join(torn, ["file", "record"], "left_semi").select("file", "block", "rel", "offset", "record")
    pieces = _pieces(spark, path).mapInArrow(_located, "file string, block long, rel long, value binary").join(want, ["file", "block", "rel"])
    whole = pieces.groupBy("file", "record").applyInPandas(_joined, "file string, offset long, bytes2 long, sha2 string")
    records = records.join(whole, ["file", "offset"], "left")
    return records.withColumn("sha1", F.coalesce("sha1", "sha2")).withColumn("bytes", F.coalesce("bytes", "bytes2")).drop("sha2", "bytes2")


def _located(it):
    now, rel = None, 0
    for b in it:
        out = []
        for file, block, value in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value")):
            if (file, block) != now:
                now, rel = (file, block), 0 if block == 0 else -len(MAGIC)
                first = block == 0
            else:
                first = False
            out.append(rel)
            rel += len(value.as_buffer()) + (0 if first else len(MAGIC))
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(out, pa.int64()), b.column("value")], ["file", "block", "rel", "value"])


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of every record of archives.

    Size and digest are those of the payload as read (a revisit's are its response's), null where it is torn
    or, for a revisit, where no response answers to its reference; intact tells if the digest is the header's.
    """
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    paths: list[str] = []
    records = materialise(read(spark, path, paths).select(number("id").alias("page_id"), "kind", F.substring("digest", 6, 32).alias("digest"), F.when(F.col("refers").isNotNull(), number("refers")).alias("to"), "bytes", "sha1"), "records")
    drop_scratch(spark, paths)
    first = records.filter("kind = 'response'").groupBy(F.col("page_id").alias("to"), F.col("digest")).agg(F.first("bytes").alias("full"), F.first("sha1").alias("of"))
    revisits = records.filter("kind = 'revisit'").join(first, ["to", "digest"], "left")
    cols = lambda size, sha, to: ["page_id", F.col(size).alias("payload_bytes"), F.col(sha).alias("payload_digest"), F.col("kind").alias("record_type"), to.alias("refers_to"), F.coalesce(F.col(sha) == F.col("digest"), F.lit(False)).alias("intact")]
    return records.filter("kind = 'response'").select(*cols("bytes", "sha1", F.lit(None).cast("long"))).unionByName(revisits.select(*cols("full", "of", F.col("to"))))


def archive(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages and reads the archives back, as `pages_of` gives them."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return pages_of(pages.sparkSession, path)
