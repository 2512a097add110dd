"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct five-word shingles (A-Z lowered; with fewer words, the whole sequence
as one). Documents with equal sets are one class; the join works on classes.

Every tree branches the classes by one minwise token at the root. A node of at most `node_limit`
classes is compared exhaustively, by 32-byte sketches; what may be similar becomes a candidate edge. A
larger node is first compared with a leader of its own: classes close to the leader get an edge to it
and leave the node, the rest branches again by two further minwise tokens that are not on the path.
What is still large after `depth` levels is compared whole: cut into blocks by a hash, every block within
itself and with every other, so that no pair of the node goes unseen. `trees` independent trees give a
pair at the threshold a miss probability of 0.25**trees at the roots (12 trees: 6e-8).

Candidate edges form clusters, and within clusters links are confirmed on the full sets, which are
made again from the whole texts: pairs whose sizes allow the threshold and that are not yet connected
are intersected exactly. Clusters over `cluster_limit` classes or `set_limit` shingles are cut into
blocks that each get the cluster's pivot; the classes not connected with the pivot are cut into parts
by the same limits, and every part is compared with every block, so that no pair goes unseen and a
task holds one block and one part at most. Only spanning links leave a task, never all pairs of a group.

Defined cases: null, empty or blank texts have the empty set, are linked with nothing and stay; a null
doc_id counts as larger than all others; rows that repeat a doc_id keep their own sets, share links
and are all kept where that id is; a very long text is one set, in a block of its own size; an empty
table gives an empty result; other columns are ignored, and `keep_first` passes them on under any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MAX_ID, batched, drop_scratch, grams, join_texts, materialise, mix, rid, text_bytes, units, whole_row, words_of
from quarry.llm.graph import Forest, components

POSITIONS = 32
WIDTH = 5
_rng = np.random.Generator(np.random.PCG64(80))
XOR = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
MUL = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
INV = np.array([pow(int(x), -1, 1 << 64) for x in MUL], np.uint64)
LIKELY, CLOSE, POSSIBLE = 12, 22, 8  # of 32 sketch bytes: candidate edge, close to a leader, worth an exact check


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, at = join_texts(texts)
    s, _, h = words_of(buf, lower=True)
    edge = np.append(np.searchsorted(s, at), len(s))
    g = grams(h, WIDTH, 5)
    out = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo >= WIDTH:
            out.append(np.unique(g[lo : hi - WIDTH + 1]))
        elif hi > lo:
            out.append(mix(grams(h[lo:hi], hi - lo, 50 + hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, none of them empty, the token (a shingle hash) that is smallest under each of the 32 orders."""
    out = np.empty((len(sets), POSITIONS), np.uint64)
    if sets:
        size = np.array([len(x) for x in sets])
        x, at = np.concatenate(sets), np.cumsum(size) - size
        for i in range(POSITIONS):
            out[:, i] = np.minimum.reduceat((x ^ XOR[i]) * MUL[i], at)
    return out * INV ^ XOR


def signature(x: np.ndarray) -> np.ndarray:
    return signatures([x])[0]


def sketch(sig: np.ndarray) -> bytes:
    return mix(sig).astype(np.uint8).tobytes()


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _sign(it):
    for b in units(it, "text", 1 << 20):
        sets = shingle_sets(b.column("text").to_pylist())
        made = iter(signatures([x for x in sets if len(x)]))
        sig = [next(made).tobytes() if len(x) else None for x in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("rid"), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), pa.array(sig, pa.binary())],
            ["doc_id", "rid", "n", "cls", "sig"],
        )


NODE = "path long, taken array<long>, cls binary, sketch binary"
_node_names = ["path", "taken", "cls", "sketch"]


def _node_batch(path, taken, cls, sk):
    return pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(taken, pa.list_(pa.int64())), pa.array(cls, pa.binary()), pa.array(sk, pa.binary())], _node_names)


def _roots(trees: int):
    def run(it):
        for b in it:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, POSITIONS)
            cls = b.column("cls").to_pylist()
            sk = [sketch(x) for x in sig]
            for t in range(trees):
                token = sig[:, t]
                yield _node_batch(mix(token + np.uint64(t)).view(np.int64), token.view(np.int64)[:, None].tolist(), cls, sk)

    return run


def _branch(width: int):
    """The children of classes in large nodes: further minwise tokens, chosen by the path."""

    def run(it):
        for b in it:
            path, taken, cls, sk = [], [], [], []
            for p, on, c, k, s in zip(*(b.column(n).to_pylist() for n in ("path", "taken", "cls", "sketch", "sig"))):
                sig = np.frombuffer(s, np.uint64).view(np.int64).tolist()
                order = np.random.Generator(np.random.PCG64(p & MAX_ID)).permutation(POSITIONS)
                new = [x for x in dict.fromkeys(sig[i] for i in order) if x not in on][:width]
                for x in new:
                    path.append(int(mix(np.array([p ^ x], np.int64).view(np.uint64)).view(np.int64)[0]))
                    taken.append([*on, x])
                    cls.append(c)
                    sk.append(k)
            yield _node_batch(path, taken, cls, sk)

    return run


def _equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 32 bytes of each row are equal: eight flags are added at a time."""
    eights = np.ascontiguousarray(x == y).view(np.uint64).reshape(-1, POSITIONS // 8)
    total = eights[:, 0] + eights[:, 1] + eights[:, 2] + eights[:, 3]
    return (total * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


def _alike(sk: np.ndarray, i: int) -> np.ndarray:
    return _equal_bytes(sk[i + 1 :], sk[i])


def _node_edges(cls: list[bytes], sk: list[bytes]):
    """Spanning candidate edges of one node, and the head of each class: the first of its candidate component."""
    n = len(cls)
    m = np.frombuffer(b"".join(sk), np.uint8).reshape(n, -1)
    f, edges = Forest(n), []
    for i in range(n - 1):
        for j in (np.flatnonzero(_alike(m, i) >= LIKELY) + i + 1).tolist():
            if f.join(i, j):
                edges.append((cls[i], cls[j]))
    return edges, [f.find(i) for i in range(n)]


def _groups(it, key: str, names: list[str]):
    """The rows of each key of a sorted stream."""
    now, rows = None, None
    for b in it:
        cols = [b.column(c).to_pylist() for c in (key, *names)]
        for k, *row in zip(*cols):
            if rows is not None and k != now:
                yield now, rows
                rows = []
            now = k
            rows = rows if rows is not None else []
            rows.append(row)
    if rows:
        yield now, rows


EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _edge_batch(edges):
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.binary()), pa.array([y for _, y in edges], pa.binary())], schema=EDGE)


def _compare_nodes(it):
    """Exhaustive comparison of nodes: edges."""
    out = []
    for _, rows in _groups(it, "key", ["cls", "sketch"]):
        if len(rows) > 1:
            out += _node_edges([r[0] for r in rows], [r[1] for r in rows])[0]
        if len(out) > 20000:
            yield _edge_batch(out)
            out = []
    yield _edge_batch(out)


BLOCK = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("path", pa.int64()), ("block", pa.int64()), ("blocks", pa.int64()), ("sketch", pa.binary())])


def _compare_blocks(it):
    """Exhaustive comparison within blocks: edges (a, b), and in nodes of several blocks a row with the path for each
    distinct sketch of the block: a class that has it, and as b the head of the class's component in the block."""
    for _, rows in _groups(it, "key", ["path", "block", "blocks", "cls", "sketch"]):
        cls, sk = [r[3] for r in rows], [r[4] for r in rows]
        edges, heads = _node_edges(cls, sk)
        none = [None] * len(edges)
        yield pa.RecordBatch.from_arrays([*_edge_batch(edges).columns, pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], schema=BLOCK)
        path, block, blocks = rows[0][:3]
        if blocks > 1:
            first = {}  # equal sketches have the same edges to other blocks
            for i, x in enumerate(sk):
                first.setdefault(x, i)
            k = list(first.values())
            same = lambda x: pa.array([x] * len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in k], pa.binary()), pa.array([cls[heads[i]] for i in k], pa.binary()), same(path), same(block), same(blocks), pa.array([sk[i] for i in k], pa.binary())], schema=BLOCK)


def _compare_pairs(it):
    """Exhaustive comparison of two blocks of a node with each other; classes with one head are connected already."""
    for _, rows in _groups(it, "key", ["block", "cls", "head", "sketch"]):
        number = {}
        head = np.array([number.setdefault(r[2], len(number)) for r in rows])
        one = np.array([r[0] == rows[0][0] for r in rows])
        m = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        other = np.flatnonzero(~one)
        m2, head2, f, apart, edges = m[other], head[other], Forest(len(number)), len(number), []
        for i in np.flatnonzero(one).tolist():
            if apart == 1:
                break
            at = np.flatnonzero(_equal_bytes(m2, m[i]) >= LIKELY)
            for j in at[np.unique(head2[at], return_index=True)[1]].tolist():
                if f.join(int(head[i]), int(head2[j])):
                    edges.append((rows[i][1], rows[int(other[j])][1]))
                    apart -= 1
        yield _edge_batch(edges)


def _grouped(rows: DataFrame, run, schema: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "cls").mapInArrow(run, schema)


def _whole(rest: DataFrame, size: int, paths: list[str]) -> DataFrame:
    """Spanning candidate edges of nodes of any size (path, cls, sketch): every pair of a node is compared, by blocks of about `size`."""
    counts = materialise(rest.groupBy("path").agg(F.ceil(F.count("*") / size).alias("blocks")), "counts", paths)
    rows = rest.join(counts, "path").withColumn("block", F.pmod(F.xxhash64("path", "cls"), F.col("blocks")))
    rows = rows.withColumn("key", F.xxhash64("path", "block")).select("key", "path", "block", "blocks", "cls", "sketch")
    found = materialise(_grouped(rows, _compare_blocks, "a binary, b binary, path long, block long, blocks long, sketch binary"), "blocks", paths)
    edges = found.filter("path is null").select("a", "b")
    parts = found.filter("path is not null")
    if not parts.limit(1).count():
        return edges
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("other <> block")
    key = F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))
    pairs = parts.select(key.alias("key"), "block", F.col("a").alias("cls"), F.col("b").alias("head"), "sketch")
    return edges.union(_grouped(pairs, _compare_pairs, "a binary, b binary"))


def _near_leader(it):
    for b in it:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sketch", "lead_sketch"))
        yield b.append_column("same", pa.array(_equal_bytes(x, y), pa.int32()))


def candidate_edges(classes: DataFrame, trees: int = 12, node_limit: int = 1024, depth: int = 3, width: int = 2, paths: list[str] | None = None) -> DataFrame:
    """Spanning candidate edges (a, b) of all tree nodes; classes has cls, sig. The scratch tables under the result are added to paths."""
    paths = [] if paths is None else paths
    nodes = classes.select("cls", "sig").mapInArrow(_roots(trees), NODE)
    edges = small = whole = None
    for level in range(depth + 1):
        # written before it is joined: AQE splits hot paths only where neither side is an aggregate of the same stage; sorted at
        # every size, as a written side that is broadcast up to some size only makes the work on small tables say nothing of large ones
        counts = materialise(nodes.groupBy("path").agg(F.count("*").alias("c")).filter("c > 1"), f"counts{level}", paths)
        nodes = materialise(nodes.join(counts.hint("merge"), "path"), f"nodes{level}", paths)
        of_level = nodes.filter(F.col("c") <= node_limit).select(F.col("path").alias("key"), "cls", "sketch")
        small = of_level if small is None else small.union(of_level)  # a path is a node of one level
        large = nodes.filter(F.col("c") > node_limit).drop("c")
        if not large.limit(1).count():
            break
        lead = large.groupBy("path").agg(F.min(F.struct(F.xxhash64("path", "cls").alias("h"), "cls", "sketch")).alias("m"))
        lead = materialise(lead.select("path", F.col("m.cls").alias("lead"), F.col("m.sketch").alias("lead_sketch")), f"lead{level}", paths)
        near = large.join(lead, "path").mapInArrow(_near_leader, NODE + ", lead binary, lead_sketch binary, same int")
        near = materialise(near, f"near{level}", paths)
        led = near.filter((F.col("same") >= LIKELY) & (F.col("cls") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("cls").alias("b"))
        edges = led if edges is None else edges.union(led)
        rest = near.filter((F.col("same") < CLOSE) | (F.col("cls") == F.col("lead"))).select("path", "taken", "cls", "sketch")
        if level < depth:
            nodes = rest.join(classes.select("cls", "sig").hint("merge"), "cls").select("path", "taken", "cls", "sketch", "sig").mapInArrow(_branch(width), NODE)
            nodes = materialise(nodes, f"branches{level}", paths)
        else:
            whole = _whole(rest.select("path", "cls", "sketch"), 4 * node_limit, paths)
    found = _grouped(small, _compare_nodes, "a binary, b binary")
    for more in (edges, whole):
        found = found if more is None else found.union(more)
    return found

SLOTS = 1 << 20  # of hashes, by their lowest bits


def _marked(mark: np.ndarray, slots: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many slots of each of some sets, none of them empty, are marked."""
    if not len(start):
        return np.empty(0, np.int64)
    first = np.cumsum(size) - size
    return np.add.reduceat(mark[slots[np.repeat(start - first, size) + np.arange(int(size.sum()))]], first, dtype=np.int64)


def _links(sets: list[np.ndarray], sk: np.ndarray, num: int, den: int, fresh: np.ndarray | None = None, f: Forest | None = None):
    """Spanning confirmed links (i, j); with `fresh`, only pairs of which at least one is fresh."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    f = f or Forest(n)
    start = np.cumsum(size) - size
    slots = np.concatenate(sets).astype(np.uint32) & np.uint32(SLOTS - 1) if n else None
    mark = np.zeros(SLOTS, bool)
    for i in range(n - 1):
        m = (_alike(sk, i) >= POSSIBLE) & (np.minimum(size[i], size[i + 1 :]) * den >= np.maximum(size[i], size[i + 1 :]) * num)
        if fresh is not None and not fresh[i]:
            m &= fresh[i + 1 :]
        at = np.flatnonzero(m) + i + 1
        if len(at) > 4:  # no intersection is larger than the number of a set's slots that the other has too
            own = f.find(i)
            at = np.array([j for j in at.tolist() if f.find(j) != own], np.int64)
            mark[slots[start[i] : start[i] + size[i]]] = True
            most = [_marked(mark, slots, start[x], size[x]) for x in np.array_split(at, 1 + int(size[at].sum()) // SLOTS)]
            mark[slots[start[i] : start[i] + size[i]]] = False
            most = np.concatenate(most)
            at = at[most * den >= num * (size[i] + size[at] - most)]
        for j in at.tolist():
            if f.find(i) == f.find(j):
                continue
            a, b = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            on = np.searchsorted(b, a)
            both = int((b[np.minimum(on, len(b) - 1)] == a).sum())
            if both * den >= num * (size[i] + size[j] - both) and f.join(i, j):
                yield i, j


def _confirm(num: int, den: int):
    """Confirms the links of clusters or blocks. role: 0 member, 1 the pivot, 2 compared with all (residue)."""

    def run(it):
        for key, rows in _groups(it, "key", ["cls", "role", "text", "large"]):
            rows.sort(key=lambda r: (r[0], -r[1]))
            rows = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][0] != r[0]]
            cls, role = [r[0] for r in rows], np.array([r[1] for r in rows])
            sets, sk, ok = [], [], []
            for lo in range(0, len(rows), 256):
                made = shingle_sets([r[2] for r in rows[lo : lo + 256]])
                at = [i for i, x in enumerate(made) if len(x) and digest(x) == cls[lo + i]]  # rows may share an id
                ok += [lo + i for i in at]
                sets += [made[i] for i in at]
                sk.append(mix(signatures([made[i] for i in at])).astype(np.uint8))
            cls, sk, role, large = [cls[i] for i in ok], np.concatenate(sk), role[ok], rows[0][3]
            if len(cls) < 2:
                continue
            order = np.argsort(role != 1, kind="stable")  # the pivot first: it joins most
            cls, sets, sk, role = [cls[i] for i in order], [sets[i] for i in order], sk[order], role[order]
            f = Forest(len(cls))
            links = list(_links(sets, sk, num, den, role == 2 if (role == 2).any() else None, f))
            a, b = [cls[i] for i, _ in links], [cls[j] for _, j in links]
            if large and (role == 1).any():  # who is not connected with the pivot
                out = [c for i, c in enumerate(cls) if f.find(i) != f.find(0)]
                a += out
                b += [None] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=EDGE)

    return run


def _pieces(count: str, total: str, most: int, set_limit: int):
    """Into how many pieces a group is cut by hash, so that they have about half of what is allowed on average."""
    return F.when((F.col(count) <= most) & (F.col(total) <= set_limit), 1).otherwise(F.greatest(F.ceil(F.col(count) * 2 / most), F.ceil(F.col(total) * 2 / set_limit))).cast("long")


FILTER_BITS = 1 << 30  # at most, 128 MB: the bound of what is broadcast
SLICE = 1 << 15  # bits of one bitmap


def _only(docs: DataFrame, reps: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """The rows of docs (rid, text) that may be of `reps` (rep), by bitmaps over hashed ids: about 16 bits a rep, which let
    1 in 16 others through. Beyond `most` bits they let more through; the join that follows makes it exact either way."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(most, SLICE * (1 + 16 * reps.count() // SLICE))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    number = lambda x: F.shiftright(x, SLICE.bit_length() - 1)
    at = reps.select(number(slot("rep")).alias("slice"), slot("rep").bitwiseAND(SLICE - 1).alias("at")).repartition(n, "slice")
    maps = F.broadcast(at.groupBy("slice").agg(F.bitmap_construct_agg("at").alias("bits")))
    x = slot("rid").bitwiseAND(SLICE - 1)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(x, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.join(maps, number(slot("rid")) == F.col("slice")).filter(F.getbit(byte, x.bitwiseAND(7).cast("int")) == 1).select("rid", "text")


def confirmed_links(members: DataFrame, docs: DataFrame, num: int, den: int, cluster_limit: int = 2048, set_limit: int = 1 << 22) -> DataFrame:
    """Spanning links (a, b) within the clusters of members (cls, rep, n, label); docs has rid, text."""
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(members.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("cls").alias("pivot")), "clusters")
    docs = _only(docs, members.select("rep"))
    members = members.join(sizes, "label").withColumn("blocks", _pieces("c", "total", cluster_limit, set_limit))
    big = members.filter("blocks > 1").limit(1).count() > 0
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    sent = lambda role, large, *key: ["rep", "cls", F.xxhash64("label", *key).alias("key"), F.lit(role).alias("role"), large.alias("large")]
    rows = members.select(*sent(0, F.col("blocks") > 1, block))
    if big:
        pivots = members.filter((F.col("blocks") > 1) & (F.col("cls") == F.col("pivot"))).withColumn("k", upto("blocks"))
        rows = rows.unionByName(pivots.select(*sent(1, F.lit(True), "k")))

    def checked(rows):
        # neither side has a bounded size: both are sorted, at every size, and never broadcast; of the texts only those of members move
        texts = docs.join(rows.hint("merge"), docs["rid"] == rows["rep"]).select("key", "cls", "role", "text", "large")
        return texts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_confirm(num, den), "a binary, b binary")

    found = materialise(checked(rows), "links")
    links = found.filter("b is not null")
    if big and found.filter("b is null").limit(1).count():
        apart = members.filter("blocks > 1").join(found.filter("b is null").select(F.col("a").alias("cls")).distinct(), "cls", "left_semi")
        parts = apart.groupBy("label").agg(F.count("*").alias("r"), F.sum("n").alias("s")).select("label", _pieces("r", "s", cluster_limit, set_limit).alias("parts"))
        every = members.filter("blocks > 1").join(parts, "label").withColumn("block", block).withColumn("part", upto("parts"))
        spread = apart.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts"))).withColumn("block", upto("blocks"))
        key = ("block", "part")
        again = every.select(*sent(0, F.lit(True), *key)).unionByName(spread.select(*sent(2, F.lit(True), *key)))
        links = links.union(materialise(checked(again), "links").filter("b is not null"))
    return links


def near_groups(docs: DataFrame, num: int = 75, den: int = 100, cluster_limit: int = 2048, set_limit: int = 1 << 22, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents are linked where den * intersection >= num * union of their sets.
    """
    spark, paths = docs.sparkSession, []
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), rid().alias("rid"), text_bytes().alias("text"))
    signed = materialise(base.mapInArrow(_sign, "doc_id long, rid long, n long, cls binary, sig binary"), "signed")
    classes = signed.filter("n > 0").groupBy("cls").agg(F.min("rid").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")
    clusters = components(candidate_edges(classes, paths=paths, **how))
    drop_scratch(spark, paths)
    members = materialise(clusters.withColumnRenamed("node", "cls").join(classes.select("cls", "rep", "n"), "cls"), "members")
    links = confirmed_links(members, base.select("rid", "text"), num, den, cluster_limit, set_limit)
    labels = components(links.select("a", "b"))
    reps = classes.select("cls", "rep").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    least = materialise(reps.filter("label is not null").groupBy("label").agg(F.min("rep").alias("least")), "least")
    reps = reps.join(least, "label", "left").select("cls", F.coalesce("least", "rep").alias("component"))
    out = signed.select("doc_id", "rid", "n", "cls").join(reps, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("rid"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(component != MAX_ID, component).alias("component_id"), (F.col("rid") == component).alias("kept"),
    )


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs of which one document of each group of near copies stays, with all their columns, whatever their names."""
    kept = near_groups(docs, **how).filter("kept").select(F.coalesce("doc_id", F.lit(MAX_ID)).alias("kept_id")).distinct()
    return docs.select(rid().alias("own_id"), whole_row(docs).alias("row")).join(kept, F.col("own_id") == F.col("kept_id"), "left_semi").select("row.*")
