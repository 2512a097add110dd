"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is written as in the model (a leading space mark, spaces as marks), and its ids are those of
the segmentation whose piece scores have the largest sum, ties going to the longer last piece; a
character in no piece costs 10 less than the lowest score and becomes its bytes' pieces: the best path of
the sentencepiece library's lattice for a unigram model of the same pieces, summed in 64 bits. That is the
contract: a model file trained by merges is taken as a table of scored pieces too, and its merge order is
another segmentation (see README). Of a model's normaliser settings the leading mark is followed;
settings that change the text (character maps, dropping of spaces) are refused.

With b[e] the best score up to character e, b[e] = max over lengths l of b[e - l] + score(piece of
those l characters): linear in max-plus algebra, of order L (the longest piece). Giant documents are
cut into chunks anywhere; a chunk's effect on the vector (b[p], b[p-1], ..., b[p-L+1]) is an L x L
transfer matrix. The matrices of a document are combined associatively by a doubling scan, which gives
every chunk its true incoming vector; from that each chunk is backtraced independently for each
outgoing state, and the states are followed from the end. Where no piece can cross a position (next
to a line feed, before a space mark after another character), the matrix has rank one, and the words
between such positions are encoded once per distinct word.

Defined cases: null or empty text has no ids and decodes to the empty text; a text with the space mark
U+2581 itself decodes to a space there (lossless is then false); null ids, repeated rows and further
columns pass through as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batched, materialise, units

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NEG = float("-inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        shift += 7
        if c < 128:
            return out, i


def _fields(b: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Pieces:
    """Scored pieces of a model, exact best segmentations, and a cache by word."""

    CACHE = 150_000
    SHORT = 48

    def __init__(self, proto: bytes):
        self.score, self.id, self.byte, self.raw = {}, {}, {}, []
        lowest, settings = 0.0, {}
        for number, value in _fields(proto):
            if number == 3:
                settings |= dict(_fields(value))
            if number != 1:
                continue
            d = dict(_fields(value))
            text, kind, i = d[1].decode(), d.get(3, 1), len(self.raw)
            raw = b""
            if kind in (1, 4):
                self.score[text], self.id[text] = float(np.frombuffer(d[2], "<f4")[0]), i
                lowest = min(lowest, self.score[text])
                raw = text.replace(MARK, " ").encode()
            elif kind == 6:
                self.byte[int(text[3:5], 16)] = i
                raw = bytes([int(text[3:5], 16)])
            self.raw.append(raw)
        # fixed values: fields of the normaliser's settings, all flags being set where they are left out
        if settings.get(2) or settings.get(4, 1) or not settings.get(5, 1):
            raise ValueError("models that map characters, drop spaces or leave them unmarked are not supported")
        self.prefix = MARK if settings.get(3, 1) else ""
        self.unknown = lowest - 10
        self.longest = max(map(len, self.score))
        inner = [t for t in self.score if len(t) > 1]
        self.pairs = {t[i : i + 2] for t in inner for i in range(len(t) - 1)}
        # words can be cut out plainly if nothing joins a line feed or a mark after something else
        self.plain = not any("\n" in x or (x[1] == MARK and x[0] != MARK) or "\0" in x for x in self.pairs)
        self.heads = {t[:i] for t in inner for i in range(1, len(t))}  # what longer pieces begin with
        self.cache: dict[str, bytes] = {"": b""}
        self._trie(inner)

    def _trie(self, inner: list[str]) -> None:
        """A dense trie of the pieces of the most usual alphabet, for walks over many words at a time."""
        single = sorted((c for c in self.score if len(c) == 1 and c != MARK), key=self.score.get, reverse=True)
        usual = {MARK, *single[:254]}  # codes fit in a byte
        self.code = {c: i + 1 for i, c in enumerate(sorted(usual))}
        nodes, marks = [{}], [-1]
        for t in [*sorted(usual & self.score.keys()), *inner]:
            if not usual.issuperset(t):
                continue
            at = 0
            for c in map(self.code.__getitem__, t):
                to = nodes[at].get(c)
                if to is None:
                    to = nodes[at][c] = len(nodes)
                    nodes.append({})
                    marks.append(-1)
                at = to
            marks[at] = self.id[t]
        self.next = np.zeros((len(nodes), len(usual) + 1), np.uint16 if len(nodes) < 1 << 16 else np.int32)
        for i, edges in enumerate(nodes):
            for c, to in edges.items():
                self.next[i, c] = to
        self.mark = np.array(marks, np.int32)
        scores = np.full(len(self.raw), NEG)
        for t, i in self.id.items():
            scores[i] = self.score[t]
        self.gain = np.where(self.mark >= 0, scores[self.mark], NEG)

    # --- exact segmentation ------------------------------------------------------------------

    def value(self, piece: str):
        v = self.score.get(piece)
        return self.unknown if v is None and len(piece) == 1 else v

    def forward(self, z: str, lo: int, hi: int, best: dict, start: dict) -> None:
        """Fills best and start at (lo, hi]; best has values before as far as they may be used."""
        get, L = self.score.get, self.longest
        for e in range(lo + 1, hi + 1):
            top, at = NEG, -1
            for s in range(max(e - L, 0), e):
                b = best.get(s)
                if b is None or b == NEG:
                    continue
                v = get(z[s:e])
                if v is None:
                    if e - s > 1:
                        continue
                    v = self.unknown
                if b + v > top:
                    top, at = b + v, s
            best[e], start[e] = top, at

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def trace(self, z: str, start: dict, e: int, stop: int) -> tuple[list[int], int]:
        """Ids of the pieces that end after `stop`, back from e, and where the first of them starts."""
        parts = []
        while e > stop:
            parts.append(self.ids_of(z[start[e] : e]))
            e = start[e]
        return [i for p in reversed(parts) for i in p], e

    def word(self, w: str) -> tuple[bytes, float]:
        """The best segmentation of a whole word: the same recurrence, pushed forward along known prefixes."""
        n, get, heads = len(w), self.score.get, self.heads
        best, start = [0.0] + [NEG] * n, [0] * (n + 1)
        for s in range(n):
            b = best[s]
            for e in range(s + 1, n + 1):
                x = w[s:e]
                v = get(x)
                if v is None:
                    if e == s + 1:
                        v = self.unknown
                    elif x in heads:
                        continue
                    else:
                        break
                if b + v > best[e]:
                    best[e], start[e] = b + v, s
                if x not in heads:
                    break
        ids, _ = self.trace(w, start, n, 0)
        return np.array(ids, "<i4").tobytes(), best[n]

    # --- words -------------------------------------------------------------------------------

    def words(self, s: str) -> list[str]:
        """Parts between positions that no piece can cross."""
        if self.plain and "\0" not in s:
            s = s.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0")
            if MARK + "\0" + MARK in s:
                s = s.replace(MARK + "\0" + MARK, MARK + MARK).replace(MARK + "\0" + MARK, MARK + MARK)
            return s.split("\0")
        cut = [0, *(i for i in range(1, len(s)) if s[i - 1 : i + 1] not in self.pairs), len(s)]
        return [s[a:b] for a, b in zip(cut, cut[1:])]

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of distinct words: those of the usual alphabet many at a time."""
        out, short, codes = {}, [], []
        for w in words:
            if len(w) <= self.SHORT:
                try:
                    codes.append(bytes(map(self.code.__getitem__, w)))
                    short.append(w)
                    continue
                except (KeyError, ValueError):
                    pass
            out[w] = self.word(w)[0]
        for lo in range(0, len(short), 1 << 14):
            part = codes[lo : lo + (1 << 14)]
            lens = np.fromiter(map(len, part), np.int64, len(part))
            n = int(lens.max())
            x = np.frombuffer(b"".join([c.ljust(n, b"\0") for c in part]), np.uint8).reshape(-1, n).T
            out.update(zip(short[lo : lo + (1 << 14)], self._solve(np.ascontiguousarray(x), lens) if n else [b""] * len(part)))
        return out

    def _solve(self, x: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """x[i] has the codes of the i-th characters of words, 0 beyond their ends; the recurrence of `word`, by columns."""
        n, m = x.shape
        best = np.full((n + 1, m), NEG)
        best[0] = 0
        start, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        width = self.next.shape[1]
        flat = self.next.reshape(-1)
        for s in range(n):
            alive = np.flatnonzero(lens > s)
            node, base = np.zeros(len(alive), np.int64), best[s, alive]
            for e in range(s + 1, min(n, s + self.longest) + 1):
                node = flat[node * width + x[e - 1, alive]].astype(np.int64)
                on = np.flatnonzero(node)
                if len(on) < len(node):
                    alive, node, base = alive[on], node[on], base[on]
                if not len(alive):
                    break
                sums = base + self.gain[node]
                up = np.flatnonzero(sums > best[e, alive])
                k = alive[up]
                best[e, k], start[e, k], piece[e, k] = sums[up], s, self.mark[node[up]]
        at, rows = lens.copy(), []
        count = np.zeros(m, np.int64)
        while at.any():
            on = at > 0
            w = np.arange(m)
            rows.append(np.where(on, piece[at, w], -1))
            count += on
            at = np.where(on, start[at, w], 0)
        if not rows:
            return [b""] * m
        ids = np.stack(rows[::-1], 1).astype("<i4")  # what precedes a word's first id is padding
        raw, width = ids.tobytes(), 4 * ids.shape[1]
        return [raw[(i + 1) * width - 4 * c : (i + 1) * width] for i, c in enumerate(count.tolist())]

    def learn(self, lists: list[list[str]]) -> list[bytes]:
        """The encodings of lists of words; each distinct word is solved once while the cache holds it."""
        if len(self.cache) > self.CACHE:
            self.cache = {"": b""}
        new = {w for words in lists for w in words}
        new.difference_update(self.cache)
        self.cache.update(self.solve(list(new)))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in lists]

    def total(self, words: list[str]) -> float:
        return sum(self.word(w)[1] for w in words)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.learn([self.words(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts])

    def decode(self, ids) -> bytes:
        raw = b"".join([self.raw[i] for i in ids])
        return raw[1:] if self.prefix and raw[:1] == b" " else raw

    # --- chunks ------------------------------------------------------------------------------

    def _cuts(self, z: str, base: int) -> tuple[int, int] | None:
        """The first uncrossable position from base on, and the last at least L before the end."""
        end = len(z) - self.longest
        a = next((i for i in range(max(base, 1), end + 1) if z[i - 1 : i + 1] not in self.pairs), None)
        if a is None:
            return None
        return a, next(i for i in range(end, a - 1, -1) if z[i - 1 : i + 1] not in self.pairs)

    def matrix(self, left: str, text: str) -> np.ndarray:
        """m[i, o]: the best score from state i before the chunk (i characters back) to state o at its end."""
        L, z, base = self.longest, left + text, len(left)
        cuts = self._cuts(z, base)
        to = cuts[0] if cuts else len(z)
        best = {base - i: np.where(np.arange(L) == i, 0.0, NEG) for i in range(min(L, base + 1))}
        for e in range(base + 1, to + 1):
            top = np.full(L, NEG)
            for s in range(max(e - L, 0), e):
                v = self.value(z[s:e]) if s in best else None
                if v is not None:
                    top = np.maximum(top, best[s] + v)
            best[e] = top
        if not cuts:
            return np.stack([best.get(len(z) - o, np.full(L, NEG)) for o in range(L)], 1)
        mid, tail, start = self.total(self.words(z[cuts[0] : cuts[1]])), {cuts[1]: 0.0}, {}
        self.forward(z, cuts[1], len(z), tail, start)
        return best[cuts[0]][:, None] + mid + np.array([tail.get(len(z) - o, NEG) for o in range(L)])[None, :]

    def backtrace(self, left: str, text: str, v: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
        """With the incoming vector: ids common to all outgoing states, the further ids of each, and the state before the chunk from which each comes."""
        L, z, base = self.longest, left + text, len(left)
        cuts = self._cuts(z, base)
        best, start = {base - i: float(v[i]) for i in range(min(L, base + 1))}, {}
        self.forward(z, base, cuts[0] if cuts else len(z), best, start)
        as_bytes = lambda ids: np.array(ids, "<i4").tobytes()
        common, stop, came = b"", base, None
        if cuts:
            head, at = self.trace(z, start, cuts[0], base)
            common, came = as_bytes(head) + self.learn([self.words(z[cuts[0] : cuts[1]])])[0], base - at
            best, start, stop = {cuts[1]: 0.0}, {}, cuts[1]
            self.forward(z, stop, len(z), best, start)
        tails, back = [], []
        for o in range(L):
            e = len(z) - o
            if best.get(e, NEG) == NEG:
                tails.append(b"")
                back.append(0)
                continue
            ids, at = self.trace(z, start, e, stop)
            tails.append(as_bytes(ids))
            back.append(came if came is not None else base - at)
        return common, tails, back


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of (stacks of) matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def scan(m: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of matrices, by doubling."""
    m, step = m.copy(), 1
    while step < len(m):
        n = len(m) - step
        m[step:] = np.concatenate([product(m[i : min(i + 64, n)], m[i + step : min(i + 64, n) + step]) for i in range(0, n, 64)])
        step *= 2
    return m


_pieces: dict[bytes, Pieces] = {}


def pieces_of(proto: bytes) -> Pieces:
    if proto not in _pieces:
        _pieces.clear()
        _pieces[proto] = Pieces(proto)
    return _pieces[proto]


def _lists(codes: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<i4"), pa.int32()))


def _encode_small(proto: bytes, back: bool):
    def run(it):
        p = pieces_of(proto)
        for x in units(it, "text", 1 << 20):
            codes = p.encode_all(x.column("text").to_pylist())
            cols = {"doc_id": x.column("doc_id"), "ids": _lists(codes)}
            if back:
                cols["text"] = pa.array([p.decode(np.frombuffer(c, "<i4").tolist()) for c in codes], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _cut_up(chunk: int, context: int, prefix: str):
    def run(it):
        for b in it:
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                s = prefix + text.replace(" ", MARK)
                for c, lo in enumerate(range(0, len(s), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([c]), pa.array([s[max(0, lo - context) : lo]]), pa.array([s[lo : lo + chunk]])], ["row", "c", "left", "text"])

    return run


def _matrices(proto: bytes):
    def run(it):
        p = pieces_of(proto)
        for b in it:
            m = [p.matrix(x, y).tobytes() for x, y in zip(b.column("left").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("c"), pa.array(m, pa.binary())], ["row", "c", "m"])

    return run


def _incoming(order: int):
    def run(pdf):
        pdf = pdf.sort_values("c")
        m = np.stack([np.frombuffer(x, np.float64).reshape(order, order) for x in pdf["m"]])
        first = np.full((1, order), NEG)
        first[0, 0] = 0.0  # nothing before the first character
        v = np.concatenate([first, scan(m)[:-1, 0, :]])
        return pdf[["row", "c"]].assign(v=[x.tobytes() for x in v])

    return run


def _traced(proto: bytes):
    def run(it):
        p = pieces_of(proto)
        for b in it:
            out = [p.backtrace(x, y, np.frombuffer(v, np.float64)) for x, y, v in zip(*(b.column(c).to_pylist() for c in ("left", "text", "v")))]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("c"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.binary())), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                ["row", "c", "common", "tails", "back"],
            )

    return run


def _followed(pdf):
    """Follows the states from a document's end and puts its ids together."""
    import pandas as pd

    pdf = pdf.sort_values("c", ascending=False)
    state, parts = 0, []
    for common, tails, back in zip(pdf["common"], pdf["tails"], pdf["back"]):
        parts.append(common + tails[state])
        state = int(back[state])
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "ids": [np.frombuffer(b"".join(reversed(parts)), "<i4")]})


def encode(docs: DataFrame, model: str = MODEL, chunk: int = 1 << 16, back: bool = False) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text), with `back` also text, decoded from the ids.

    Texts of at least `chunk` code points are encoded in parallel chunks.
    """
    with open(model, "rb") as f:
        proto = f.read()
    p = pieces_of(proto)
    if chunk < 2 * p.longest:
        raise ValueError(f"chunk must be at least {2 * p.longest}")
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small = base.filter(F.length("text") < chunk).mapInArrow(_encode_small(proto, back), "doc_id long, ids array<int>" + ", text string" * back)
    giant = base.filter(F.length("text") >= chunk).withColumn("row", F.monotonically_increasing_id())
    giant = materialise(giant, "giant")
    if not giant.limit(1).count():
        return small
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = giant.select("row", "text").mapInArrow(_cut_up(chunk, p.longest, p.prefix), "row long, c long, left string, text string").repartition(n, "row", "c")
    chunks = materialise(chunks, "chunks")
    moves = chunks.mapInArrow(_matrices(proto), "row long, c long, m binary")
    entering = moves.groupBy("row").applyInPandas(_incoming(p.longest), "row long, c long, v binary")
    traced = chunks.join(entering, ["row", "c"]).mapInArrow(_traced(proto), "row long, c long, common binary, tails array<binary>, back array<int>")
    ids = traced.groupBy("row").applyInPandas(_followed, "row long, ids array<int>")
    long = giant.select("row", "doc_id").join(ids, "row").select("doc_id", "ids")
    return small.unionByName(_decoded(long, proto, keep=True) if back else long)


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """coded with its ids replaced by the text that they stand for."""
    with open(model, "rb") as f:
        return _decoded(coded, f.read())


def _decoded(coded: DataFrame, proto: bytes, keep: bool = False) -> DataFrame:
    def run(it):
        p = pieces_of(proto)
        for b in it:
            for at in range(0, b.num_rows, 128):
                x = b.slice(at, 128)
                texts = pa.array([p.decode(i or ()) for i in x.column("ids").to_pylist()], pa.binary()).cast(pa.string())
                x = x if keep else x.drop_columns(["ids"])
                yield x.append_column("text", texts)

    fields = [f for f in coded.schema.fields if keep or f.name != "ids"]
    rest = [f.name for f in fields if f.name != "ids"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: f.name == "ids"))
    return coded.select(*rest, "ids").mapInArrow(run, names + ", text string")
