"""Toxicity scores: a bag of subword embeddings, averaged, under a linear softmax.

A text's features are the character n-grams (bytes 3 to 6, A-Z lowered) inside its words, word ends
marked, hashed into 2**17 rows of an embedding table; unseen misspellings share the rows of the
n-grams that they keep. The mean of a text's rows, weighted by how unlike their shares in the two
classes are, goes through a linear softmax; rows and softmax are trained together in numpy by AdaGrad,
in one task, on a bounded sample of the labelled rows (`per_class` of either class, the smallest by a
hash of the id). Weights are shrunk, not cut, where the evidence is thin: rows of a few texts of one
class count a little. A fifth of the sample is set apart before weights and training; on it a
two-parameter logistic calibration, weighted back to the rate of the label among all training rows,
turns logits into scores. The softmax of a mean is linear in its rows, so
the trained model folds into two numbers per row, of fixed size (1 MB), and scoring streams over
the texts with no shuffle.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. Only the text enters a
score. Defined cases: null or empty texts get the score of the bias; very long texts are taken whole, in
pieces; other columns are ignored; with no labels, or labels of one
class, every score is the smoothed rate of the label, (ones + 1) / (rows + 2); a null doc_id is held
out unless labelled (crc32 of null is null: never learnt from); rows that share an id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BYTE, LOWER, SPACE, batched, join_texts, mix, powers, text_bytes, units

BITS = 17
SIZES = (3, 4, 5, 6)
SHRINK = 1.0  # weight of the empty evidence in a mean
FOLD = np.where(SPACE, 32, LOWER).astype(np.uint8)


def subwords(buf: bytes, at: np.ndarray, piece: int = 1 << 18):
    """For joined texts starting at `at`: (text number, row of the table) of every n-gram, in pieces."""
    a = FOLD[np.frombuffer(b"\n" + buf + b"\n", np.uint8)]
    step = max(SIZES)
    for lo in range(0, len(a), piece):
        x = a[lo : lo + piece + step - 1]
        p, inv = powers(len(x))
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(BYTE[x] * p[: len(x)], out=sums[1:])
        blank = x == 32
        seen = np.zeros(len(x) + 1, np.int32)
        np.cumsum(blank, out=seen[1:])
        for n in SIZES:
            m = min(piece, len(x) - n + 1)
            if m <= 0:
                continue
            i = np.flatnonzero(seen[n - 1 : n - 1 + m] == seen[1 : 1 + m])  # no space inside
            row = mix((sums[i + n] - sums[i]) * inv[i] + np.uint64(n)) >> np.uint64(64 - BITS)
            yield np.maximum(np.searchsorted(at, lo + i, "right") - 1, 0), row.astype(np.int64)


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of one text, how often each occurs, and the number of all."""
    rows = [r for _, r in subwords(text, np.zeros(1, np.int64))]
    rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
    unique, n = np.unique(rows, return_counts=True)
    return unique.astype(np.int32), n.astype(np.float32), len(rows)


def fit(texts: list[bytes], labels: np.ndarray, rate: float, dims: int = 6, epochs: int = 10, rows_a_step: int = 64, lr: float = 0.1, usual_z: float = 4.5, seed: int = 7):
    """(table, a, b): with v, w the two lines of table, sigmoid(a * sum(v[rows]) / (sum(w[rows]) + SHRINK) + b) is a text's score."""
    y = np.asarray(labels, np.int64)
    bags = [counts(t)[:2] for t in texts]
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(y))
    hold, train = order[: len(y) // 5], order[len(y) // 5 :]
    weight = _weights([bags[i][0] for i in train], y[train], usual_z)
    for i, (r, c) in enumerate(bags):  # in place: the sample is held once
        k = weight[r] > 0
        w = (c[k] * weight[r[k]]).astype(np.float32)
        bags[i] = r[k], w / (w.sum() + SHRINK)
    E = rng.normal(0, 0.02, (1 << BITS, dims)).astype(np.float32)
    W, b = rng.normal(0, 0.3, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    gE, gW, gb = np.full(1 << BITS, 1e-6, np.float32), np.full(W.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), rows_a_step):
            t = train[lo : lo + rows_a_step]
            t = t[[len(bags[i][0]) > 0 for i in t]]
            if not len(t):
                continue
            rows = np.concatenate([bags[i][0] for i in t])
            vals = np.concatenate([bags[i][1] for i in t])
            lens = np.array([len(bags[i][0]) for i in t])
            x = np.add.reduceat(E[rows] * vals[:, None], np.cumsum(lens) - lens)
            z = x @ W + b
            z -= z.max(1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(t)), y[t]] -= 1
            dx = np.repeat(q @ W.T, lens, 0) * vals[:, None]
            dW, db = x.T @ q, q.sum(0)
            u, inv = np.unique(rows, return_inverse=True)
            dE = np.stack([np.bincount(inv, dx[:, j], len(u)) for j in range(dims)], 1).astype(np.float32)
            gE[u] += (dE * dE).mean(1)
            E[u] -= lr * dE / np.sqrt(gE[u])[:, None]
            gW += dW * dW
            W -= lr * dW / np.sqrt(gW)
            gb += db * db
            b -= lr * db / np.sqrt(gb)
    table = (E @ (W[:, 1] - W[:, 0])).astype(np.float32)
    logit = np.array([float(table[r] @ v) for r, v in (bags[i] for i in hold)])
    a, b = _calibrate(logit, y[hold], rate)
    return np.stack([table * weight, weight]), a, b


def _weights(bags: list, y: np.ndarray, usual_z: float) -> np.ndarray:
    """The weight of each row in a text's mean: by how many standard errors z its texts' shares in the two classes
    differ, shrunk by a logistic curve around `usual_z`; rows of one text, or as common in both, get none."""
    df = np.zeros((2, 1 << BITS), np.int64)
    for rows, c in zip(bags, y):
        df[c, rows] += 1
    n0, n1 = max(int((y == 0).sum()), 1), max(int((y == 1).sum()), 1)
    p = (df[0] + df[1]) / (n0 + n1)
    z = np.abs(df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    shrunk = z / (1 + np.exp(-1.5 * (z - usual_z)))
    return np.where((df[0] + df[1] > 1) & (z > 1.4), shrunk, 0).astype(np.float32)


def _calibrate(z: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Logistic calibration by Newton steps, the classes weighted to the rate; a weak prior keeps it finite."""
    ones = y.mean() if len(y) else 0
    if not 0 < ones < 1:
        return 1.0, 0.0
    w = np.where(y == 1, rate / ones, (1 - rate) / (1 - ones))
    m, s = z.mean(), z.std() + 1e-9
    x = np.stack([(z - m) / s, np.ones(len(z))], 1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        t -= np.linalg.solve(h, x.T @ (w * (p - y)) + 0.05 * t)
    return float(t[0] / s), float(t[1] - t[0] * m / s)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000):
    """The model as (table or None, a, b), learnt from a bounded sample; labels has doc_id, toxic."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold != 0)
    stats = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).first()
    n, ones = int(stats["n"]), int(stats["ones"] or 0)
    rate = (ones + 1) / (n + 2)
    flat = (None, 0.0, float(np.log(rate / (1 - rate))))
    if ones in (0, n):
        return flat
    pick = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(pick[0].union(pick[1])), "doc_id")

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        if pdf.toxic.nunique() < 2:
            return pd.DataFrame({"table": [b""], "a": [0.0], "b": [0.0]})
        table, a, b = fit(pdf.text.tolist(), pdf.toxic.to_numpy(), rate)
        return pd.DataFrame({"table": [table.tobytes()], "a": [a], "b": [b]})

    # one task, by design: the sample is bounded by 2 * per_class rows
    model = sample.groupBy(F.lit(0).alias("_")).applyInPandas(learn, "table binary, a double, b double").first()
    if model is None or not model["table"]:
        return flat
    return np.frombuffer(bytes(model["table"]), np.float32).reshape(2, -1), model["a"], model["b"]


def scorer(model):
    table, a, b = model

    def run(it):
        heavy = table[1] > 0 if table is not None else None
        for x in units(it, "text", 1 << 20):
            texts = x.column("text").to_pylist()
            z = np.full(len(texts), b)
            if table is not None:
                total, n = np.zeros(len(texts)), np.zeros(len(texts))
                buf, at = join_texts(texts)
                for doc, row in subwords(buf, at):
                    k = np.flatnonzero(heavy[row])
                    total += np.bincount(doc[k], table[0][row[k]], len(texts))
                    n += np.bincount(doc[k], table[1][row[k]], len(texts))
                z = a * total / (n + SHRINK) + b
            yield pa.RecordBatch.from_arrays([*x.drop_columns(["text"]).columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], [*(c for c in x.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    model = train(docs, labels, per_class)
    base = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = base.mapInArrow(scorer(model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
