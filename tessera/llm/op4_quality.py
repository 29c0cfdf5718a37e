"""Quality scores by a factorisation machine.

Features of a text: hashed words (presence, scaled by the square root of their number) and one-hot bins of structure
statistics and of metadata computed from the text (its length). Pairwise interactions are low-rank, and a score takes
time linear in the features by the sum-of-squares identity: sum_{i<j} <v_i, v_j> x_i x_j = 1/2 (|sum v_i x_i|^2 -
sum |v_i x_i|^2). Weights are learnt in numpy by Adagrad on a bounded sample of labelled rows (``SAMPLE``).

Defined cases: null and empty texts are scored by the bias and their statistics' bins; whole texts are read, however
long; repeated rows give repeated rows; labels, lang, source and doc_id are never inputs; with no labels to learn from
every score is 0.5; an empty table gives no rows; a null id is scored and not held out; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .labels import held_out, labelled, remainder

SAMPLE = 4000
WORDS = 1 << 16
RANK = 8
EPOCHS = 8
THRESHOLD = 0.3
#: Upper edges of the bins of each statistic; a statistic over all of them falls in the last bin.
STATS = {
    "log2_bytes": (3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14),
    "mean_word": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10),
    "upper": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "digits": (0.001, 0.01, 0.02, 0.05, 0.1, 0.3),
    "ascii_punct": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4),
    "odd_symbols": (0.0005, 0.002, 0.01, 0.03, 0.1, 0.3),
    "pipes": (0.0005, 0.002, 0.01, 0.03, 0.1),
    "shouts": (0.0005, 0.002, 0.01, 0.03, 0.1),
    "distinct_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95),
    "repeated_lines": (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "words_a_line": (1, 2, 4, 8, 16, 32, 64, 128),
}
BINS = 16
N_FEATURES = WORDS + BINS * len(STATS)
_EDGES = [np.array(e) for e in STATS.values()]


class Featurizer:
    """(ids, x) of one text; remembers the hashes of a task's words, boundedly."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        known = self.known
        if len(known) > 500_000:
            known.clear()
        distinct = set(words)
        ids = []
        for w in distinct:
            h = known.get(w)
            if h is None:
                known[w] = h = zlib.crc32(w.lower().encode()) & (WORDS - 1)
            ids.append(h)
        ids = np.unique(np.array(ids, dtype=np.int64))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        count = np.bincount(raw, minlength=256)
        n, m = max(len(raw), 1), max(len(words), 1)
        lines = [x for x in text.split("\n") if x]
        upper = count[65:91].sum()
        punct = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
        odd = count[[35, 36, 37, 38, 42, 64, 94, 126]].sum()
        stats = (
            np.log2(n), (n - m) / m, upper / max(upper + count[97:123].sum(), 1), count[48:58].sum() / n, punct / n, odd / n, count[124] / n,
            count[33] / n, len(distinct) / m, 1 - len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1))
        bins = [WORDS + BINS * k + int(np.searchsorted(e, s, side="right")) for k, (e, s) in enumerate(zip(_EDGES, stats))]
        x = np.concatenate((np.full(len(ids), 1 / np.sqrt(max(len(ids), 1))), np.ones(len(bins))))
        return np.concatenate((ids, bins)), x


def _margins(model, ids, x, starts):
    w0, w, v = model
    vx = v[ids] * x[:, None]
    s = np.add.reduceat(vx, starts, axis=0)
    q = np.add.reduceat((vx * vx).sum(1), starts)
    return w0 + np.add.reduceat(w[ids] * x, starts) + 0.5 * ((s * s).sum(1) - q), s


def fit(features: list, y: np.ndarray, seed: int = 7):
    """(w0, w, v) by mini-batch Adagrad on logistic loss with a small L2 penalty."""
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK)), 0.0
    if len(y) == 0:
        v[:] = 0
        return w0, w.astype(np.float32), v.astype(np.float32)
    w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    gw, gv, g0 = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        rate = 0.1 / (1 + 0.3 * epoch)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            ids = np.concatenate([features[i][0] for i in part])
            x = np.concatenate([features[i][1] for i in part])
            sizes = np.array([len(features[i][0]) for i in part])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            m, s = _margins((w0, w, v), ids, x, starts)
            err = (1 / (1 + np.exp(-m)) - y[part]) / len(part)
            e = np.repeat(err, sizes)
            u, inv = np.unique(ids, return_inverse=True)
            dw = np.bincount(inv, e * x, minlength=len(u)) + 1e-5 * w[u]
            per = (e * x)[:, None] * (np.repeat(s, sizes, axis=0) - v[ids] * x[:, None])
            dv = np.stack([np.bincount(inv, per[:, f], minlength=len(u)) for f in range(RANK)], axis=1) + 1e-4 * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += err.sum() ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
            w0 -= rate * err.sum() / np.sqrt(g0)
    return w0, w.astype(np.float32), v.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """A model from at most ``most`` labelled rows outside the held-out fold."""
    rows = labelled(docs, labels, "quality", remainder("doc_id", 5) != 0, most)
    f = Featurizer()
    return fit([f(t) for t in rows["text"]], rows["y"].to_numpy(float))


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted). The model is a few megabytes, whatever the input."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        f = Featurizer()
        for batch in batches:
            made = [f(t or "") for t in batch.column(2).to_pylist()]
            if not made:
                continue
            sizes = [len(i) for i, _ in made]
            out = np.empty(len(made))
            for a in range(0, len(made), 256):
                part = made[a:a + 256]
                starts = np.concatenate(([0], np.cumsum(sizes[a:a + 256])[:-1]))
                out[a:a + 256] = _margins(shared.value, np.concatenate([i for i, _ in part]), np.concatenate([x for _, x in part]).astype(np.float32), starts)[0]
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
