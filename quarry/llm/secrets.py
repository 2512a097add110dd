"""Secret scans with multipart credential linking.

Base spans come from three patterns (assign, access, hex). Weak candidates (identifiers and secrets of
no telling form, endpoints) mean nothing alone: within a scope, a block of lines without a blank one,
they are joined by interval with what would complete them, and only those are reported of which a
complementary part lies within `reach` code points: an identifier beside a secret, a secret beside an
identifier, an endpoint beside both. Access identifiers and assigned values of the base count as
identifiers and secrets in that join.

Everything is within one document, so there is no shuffle; byte searches that cannot miss decide
whether a pattern is run on a text at all.

Defined cases: null text is empty and has no spans; null ids and repeated rows give a row each;
positions are code points of the whole text, ends exclusive; very long texts, runs and scopes cost no
more than in proportion (look-ups are logarithmic); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batched, units

KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
RANK = {k: i for i, k in enumerate(KINDS)}
REACH = 256

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WEAK_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{12,}(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
IS_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
IS_KEY = bytes(120 if chr(i) in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-" else 32 for i in range(256))


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """The leftmost non-overlapping matches of each base pattern that are long enough."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(IS_HEX):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def secretive(s: str) -> bool:
    """Whether a run of key characters looks drawn at random: three kinds of characters and 3.5 bits a character."""
    return any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s) and entropy(s) >= 3.5


class Intervals:
    """The intervals of one part by scope, sorted by start, with the two that reach farthest among every first few:
    one look-up tells if any lies within reach of another interval, however long single ones are."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: dict[int, list[int]] = {}
        self.farthest: dict[int, list[tuple]] = {}
        for scope, s, e in sorted(set(spans)):
            top = self.farthest.setdefault(scope, [((-1, -1), (-1, -1))])
            top.append(tuple(sorted((*top[-1], (e, s)), reverse=True)[:2]))
            self.starts.setdefault(scope, []).append(s)

    def __len__(self):
        return len(self.starts)

    def near(self, scope: int, start: int, end: int, reach: int | None) -> bool:
        """Whether the scope has an interval, other than (start, end) itself, at most reach away (None: anywhere)."""
        if scope not in self.starts:
            return False
        n = bisect_right(self.starts[scope], math.inf if reach is None else end + reach)
        one, two = self.farthest[scope][n]
        e, s = two if one == (end, start) else one
        return s >= 0 and (reach is None or e >= start - reach)


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int | None = REACH, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """Weak candidates of which a complementary part is near, in the same scope."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    if not any(k in ("assign", "access") for k, _, _ in base) and b"x" * 20 not in raw.translate(IS_KEY):
        return []  # no secret and no access identifier: nothing can be complete
    cover = sorted((s, e) for _, s, e in base)
    ends = [0, *accumulate((e for _, e in cover), max)]  # how far the first few spans of the base reach

    def free(s, e):
        return ends[bisect_left(cover, (e, 0))] <= s

    breaks = [m.start() for m in BLANK.finditer(text)]
    scope = lambda s, e: (bisect_left(breaks, s), s, e)
    ids = [scope(*m.span()) for m in WEAK_ID.finditer(text) if free(*m.span())]
    secrets = [scope(*m.span()) for m in WEAK_SECRET.finditer(text) if free(*m.span()) and secretive(m[0])]
    strong_ids = [scope(s, e) for k, s, e in base if k == "access"]
    strong_secrets = [scope(s, e) for k, s, e in base if k == "assign"]
    every_id, every_secret = Intervals(ids + strong_ids), Intervals(secrets + strong_secrets)
    out = [("linked_id", s, e) for k, s, e in ids if every_secret.near(k, s, e, reach)]
    out += [("linked_secret", s, e) for k, s, e in secrets if every_id.near(k, s, e, reach)]
    if every_id and every_secret:
        points = [scope(*m.span()) for m in ENDPOINT.finditer(text) if free(*m.span())]
        out += [("linked_endpoint", s, e) for k, s, e in points if every_id.near(k, s, e, reach) and every_secret.near(k, s, e, reach)]
    return out


def in_order(spans):
    return sorted(spans, key=lambda x: (x[1], RANK[x[0]], x[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, spans (kind, start, end, in order of start, then kind) of every row of docs (doc_id, text).

    Parts are linked at most `reach` code points apart within a scope; with None anywhere in it.
    """

    def run(it):
        for b in units(it, "text", 4 << 20):
            out = []
            for raw in b.column("text").to_pylist():
                text = raw.decode("utf-8", "surrogatepass")
                spans = base_spans(text, raw)
                spans += linked_spans(text, spans, reach, raw)
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in in_order(spans)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, SPANS)], ["doc_id", "spans"])

    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return base.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
